"""Validation: every rule is a branch of one issues table; data are reported on and never changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.periods import ANNUAL, DAY, MONTH, QUARTER, infer_frequency, period_slot, period_year
from almanack.functions.values import finite, safe_div, unit_family
from almanack.operators.dataset import first_variable, geo_key
from almanack.operators.outliers import modified_z


def _issues(rows: DataFrame, code: str, severity: str, variable: Column, **details: Column) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    shown = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), variable.cast("string").alias("variable"), shown.alias("details"))


def duplicate_keys(observations: DataFrame) -> DataFrame:
    """Natural keys that occur more than once, with their counts."""
    return observations.groupBy(geo_key().alias("geo_key"), "period", "provider", "series_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def time_gaps(observations: DataFrame) -> DataFrame:
    """(provider, series_id, geo_key, expected, rows, gaps): calendar slots less rows, from three rows on.

    Rows count, not distinct periods, so duplicates can hide gaps. Daily labels have no slots.
    """
    slot = period_slot(F.col("period"))
    out = observations.groupBy("provider", "series_id", geo_key().alias("geo_key")).agg((F.max(slot) - F.min(slot) + 1).cast("long").alias("expected"), F.count(slot).alias("rows"))
    return out.filter("rows >= 3").withColumn("gaps", F.col("expected") - F.col("rows")).filter("gaps > 0")


def status_counts(observations: DataFrame, top: int = 10) -> DataFrame:
    return observations.filter("status is not null and status <> ''").groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status").limit(top)


def validate(observations: DataFrame, variables: DataFrame, requested_frequency: str | None = None, requested_end: int | None = None) -> DataFrame:
    """All issues: (code, severity, variable, details)."""
    key = F.concat_ws(":", "provider", "series_id")
    name = first_variable(variables)
    rows = observations.join(name, ["provider", "series_id"], "inner").withColumn("geo_key", geo_key())
    known = F.col("period").rlike(f"{ANNUAL}|{QUARTER}|{MONTH}|{DAY}")
    present = F.col("value").isNotNull()
    each = variables.select("alias", "concept").join(
        rows.groupBy("alias").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("value").alias("have"),
            F.array_sort(F.collect_set(F.when(known, infer_frequency(F.col("period"))))).alias("frequencies"),
            F.array_sort(F.collect_set(F.when(F.col("unit") != "", F.col("unit")))).alias("units"),
            F.count_if(present & finite(F.col("value")).isNull()).alias("odd"),
        ),
        "alias",
        "left",
    )
    alias, joined = F.col("alias"), lambda c: F.array_join(c, ", ")
    families = rows.join(variables.select("alias", "concept"), "alias").filter("concept is not null").groupBy("concept").agg(F.array_sort(F.collect_set(unit_family(F.col("unit")))).alias("families")).filter("size(families) > 1")
    gaps = time_gaps(observations).join(name, ["provider", "series_id"])
    jumps = modified_z(rows, ["alias", "geo_key"], threshold=3.5)
    branches = [
        _issues(duplicate_keys(observations), "duplicate_key", "error", key, geography=F.col("geo_key"), period=F.col("period"), count=F.col("n")),
        _issues(observations.filter(~known).groupBy("provider", "series_id").agg(F.array_sort(F.collect_set("period")).alias("p")), "invalid_period", "error", key, periods=joined(F.slice("p", 1, 20))),
        _issues(each.filter("odd > 0"), "non_numeric_value", "error", alias, count=F.col("odd")),
        _issues(each.filter("size(frequencies) > 1"), "mixed_frequency", "error", alias, frequencies=joined(F.col("frequencies"))),
        _issues(each.filter("size(units) > 1"), "unit_conflict", "error", alias, units=joined(F.col("units"))),
        _issues(families, "incompatible_units_same_concept", "warning", F.col("concept"), families=joined(F.col("families"))),
        _issues(each.filter("n is null"), "missing_variable", "error", alias),
        _issues(each.filter("n > 0 and have = 0"), "all_values_missing", "error", alias),
        _issues(each.filter("have > 0 and have / n < 0.5"), "sparse_variable", "warning", alias, share=safe_div(F.col("have"), F.col("n"))),
        _issues(gaps, "time_gap", "warning", alias, geography=F.col("geo_key"), missing=F.col("gaps")),
        _issues(jumps, "extreme_jump", "info", alias, geography=F.col("geo_key"), period=F.col("period"), value=F.col("value")),
        _issues(status_counts(observations), "provider_flag", "info", F.lit(None), status=F.col("status"), count=F.col("n")),
    ]
    if requested_frequency:
        branches.append(_issues(each.filter(F.col("n").isNotNull() & ~F.array_contains("frequencies", requested_frequency)), "frequency_not_available", "warning", alias, delivered=joined(F.col("frequencies"))))
    if requested_end:
        last = rows.filter("value is not null").groupBy("alias", "geo_key").agg(F.max(period_year(F.col("period"))).alias("last")).filter(F.col("last") < requested_end)
        branches.append(_issues(last, "coverage_ends_early", "warning", alias, geography=F.col("geo_key"), last=F.col("last")))
    return reduce(DataFrame.unionByName, branches)


def verdict(issues: DataFrame) -> DataFrame:
    """One row: clean, usable_with_warnings or unusable, with counts."""
    count = lambda s: F.count_if(F.col("severity") == s)
    out = issues.agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "unusable").when(F.col("warnings") > 0, "usable_with_warnings").otherwise("clean"))


def range_checks(observations: DataFrame, ranges: DataFrame, kind: Column) -> DataFrame:
    """Observations outside their indicator type's range (``kind, low, high``), or negative where the type
    cannot be (``signed`` false, if the table says so), and whether a scale of 0.01, 100 or 0.001 would put
    them inside. Nothing is dropped."""
    rows = observations.withColumn("kind", kind).join(ranges, "kind")
    inside = lambda factor: (F.col("value") * factor >= F.col("low")) & (F.col("value") * factor <= F.col("high"))
    hint = F.when(inside(0.01), 0.01).when(inside(100.0), 100.0).when(inside(0.001), 0.001)
    sign = (F.col("value") < 0) & ~F.coalesce("signed", F.lit(True)) if "signed" in ranges.columns else F.lit(False)
    return rows.filter(~inside(1.0) | sign).withColumn("scale_hint", hint).withColumn("sign_error", sign).withColumn("severity", F.when(hint.isNotNull() & ~sign, "warning").otherwise("error"))


def confidence(checked: DataFrame, by: list[str]) -> DataFrame:
    """1 less .2 for each error and .1 for each warning of a series, not under 0."""
    penalty = F.sum(F.when(F.col("severity") == "error", F.lit(2)).otherwise(F.lit(1)))
    return checked.groupBy(*by).agg(F.greatest(F.lit(0), 10 - penalty).cast("double").alias("p")).select(*by, (F.col("p") / 10).alias("confidence"))

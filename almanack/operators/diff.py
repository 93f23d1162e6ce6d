"""Differences between two versions of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.operators.dataset import geo_key

KEY = ["provider", "series_id", "geo_key", "period"]


def last_values(observations: DataFrame) -> DataFrame:
    """One value for each key: the last to arrive (the pivot takes the first; versions the last)."""
    rows = observations.withColumn("geo_key", geo_key())
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("value"), "obs_seq")["value"].alias("value"))


def changes(previous: DataFrame, current: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(key, old, new, change): new, updated or removed observations.

    A NaN never differs from a number, as it compares false; null against a value does.
    """
    old = last_values(previous).withColumnRenamed("value", "old").withColumn("_a", F.lit(1))
    new = last_values(current).withColumnRenamed("value", "new").withColumn("_b", F.lit(1))
    both = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY], "full_outer")
    apart = F.abs(F.col("old") - F.col("new"))
    differs = (F.col("old").isNull() != F.col("new").isNull()) | ((apart > tolerance) & ~F.isnan(apart))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.coalesce(differs, F.lit(False)), "updated")
    return both.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in KEY), "old", "new", kind.alias("change")).filter("change is not null")


def change_counts(previous: DataFrame, current: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    count = lambda k: F.count_if(F.col("change") == k)
    return changes(previous, current, tolerance).agg(count("new").alias("new_observations"), count("updated").alias("updated_observations"), count("removed").alias("removed_observations"))


def metadata_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Current variables that are new or differ in title, unit, frequency or coverage end: the first such."""
    fields = ("title", "unit", "frequency", "coverage_end")
    old = previous.select("provider", "series_id", *(F.col(f).alias(f"old_{f}") for f in fields)).withColumn("_a", F.lit(1))
    rows = current.join(old, ["provider", "series_id"], "left")
    what = F.when(F.col("_a").isNull(), "variable")
    for f in fields:
        what = what.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), f)
    return rows.withColumn("changed", what).filter("changed is not null").select("alias", "provider", "series_id", "changed")

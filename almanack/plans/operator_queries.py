"""Registered queries that run the remaining operators, requests, exports and streams, with their oracle SQL."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.functions import periods, text, values
from almanack.operators import cube, dataset, derive, describe, diff, geography, missing, outliers, search, survey_stats, validate
from almanack.plans import recipes, requests, vocabulary
from almanack.plans.queries import OBS, WIDE, _cells, _wide
from almanack.plans.registry import query
from almanack.plans.source_queries import ANNUAL, annual
from almanack.schema import OBSERVATIONS, VARIABLES
from almanack.sources import driver_tables as tables
from almanack.sources import exports, landing
from almanack.streaming import streams


def _values(names: str, *rows: str) -> str:
    """An oracle of fixed rows."""
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({names})"


def _dataset(spark: SparkSession, sf: str) -> dataset.Dataset:
    return dataset.Dataset(tables.observations(spark, sf), tables.variables(spark), tuple(tables.ALIASES), transformations=({"operation": "build_dataset", "parameters": {}},))


# Projections and filters


@query(OBS + " SELECT geography, period, 'orders:' || series_id AS indicator, value FROM obs WHERE series_id <> 'BUILDING' UNION ALL SELECT geography, period, 'homes', value FROM obs WHERE series_id = 'BUILDING'")
def transform_by_name(spark, sf):
    """Any operation by its name; the shape decides what ``rows`` returns."""
    d = _dataset(spark, sf).transform("select_variables", names=["building"]).transform("rename_variable", old="building", new="homes").transform("set_shape", shape="long")
    return d.rows().select("geography", "period", "indicator", "value")


@query(OBS + ", s AS (SELECT *, series_id IN ('BUILDING', 'MACHINERY') AS gone FROM obs) SELECT series_id, count(*)::BIGINT AS n FROM s WHERE NOT gone GROUP BY 1")
def null_series_filter(spark, sf):
    """Series without any value go, others keep their nulls."""
    value = F.when(~F.col("series_id").isin("BUILDING", "MACHINERY") & (F.col("obs_seq") % 2 == 0), F.col("value"))
    rows = derive.with_values(tables.observations(spark, sf).withColumn("value", value), ["series_id"])
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) <= 1995 OR o_orderkey % 9 = 0")
def year_trim(spark, sf):
    o = tables.read(spark, sf, "orders").withColumn("d", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderdate").cast("string")))
    return derive.in_years(o, "d", None, 1995).select("o_orderkey")


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g') AS slug, array_to_string((string_split(regexp_replace(lower(p_name || ' é ' || p_type || ' x y'), '[^a-z0-9é]+', '_', 'g'), '_'))[1:5], '_').replace('é', 'e') || CASE p_partkey % 4 WHEN 0 THEN '_pct_gdp' WHEN 1 THEN '_const2015usd' WHEN 2 THEN '_idx' ELSE '' END AS alias FROM part")
def aliases(spark, sf):
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, "% of GDP").when(k == 1, "Constant 2015 US$").when(k == 2, "Index, 2010 = 100")
    title = F.concat_ws(" ", "p_name", F.lit("É"), "p_type", F.lit("x y"))
    return tables.read(spark, sf, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("slug"), text.smart_alias(title, F.lit("s"), unit, F.lit(None).cast("string")).alias("alias"))


@query("SELECT p_partkey AS ordinal, p_brand || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS alias FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def alias_numbers(spark, sf):
    return dataset.alias_numbers(tables.read(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("alias"))).select("ordinal", "alias")


@query(OBS + ", p AS (SELECT DISTINCT geography, period FROM obs ORDER BY geography, period LIMIT 25) SELECT geography, period, (SELECT count(*) FROM (SELECT DISTINCT geography, period FROM obs)) > 25 AS more FROM p")
def preview_cap(spark, sf):
    rows, more = _dataset(spark, sf).preview(25)
    return spark.createDataFrame([(r.geography, r.period, more) for r in rows], "geography string, period string, more boolean")


@query("WITH t AS (SELECT count(*) AS n FROM lineitem) SELECT least(n, CASE WHEN n * 26 > 250000 AND n > 10000 THEN 10000 ELSE n END)::BIGINT AS rows, n * 26 > 250000 AND n > 10000 AS sampled FROM t")
def profiling_sample(spark, sf):
    """Exactly 10,000 rows of a table that is over both bounds, and all of any other; it says which."""
    table = tables.read(spark, sf, "lineitem")
    out, sampled = describe.profiling_sample(table, table.count(), 26)
    return out.agg(F.count(F.lit(1)).alias("rows")).withColumn("sampled", F.lit(sampled))


@query("WITH d AS (SELECT DISTINCT o_orderdate::DATE AS today, unnest(['comtrade', 'coingecko', 'fred']) AS provider FROM orders) SELECT provider, today, CASE provider WHEN 'comtrade' THEN (year(today) - 10)::VARCHAR WHEN 'coingecko' THEN (today - 30)::VARCHAR END AS first, CASE provider WHEN 'comtrade' THEN year(today)::VARCHAR WHEN 'coingecko' THEN today::VARCHAR END AS last FROM d")
def default_windows(spark, sf):
    """The window of each provider for requests made on each day of an order."""
    days = tables.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("today")).distinct()
    asked = days.withColumn("provider", F.explode(F.array(*map(F.lit, ("comtrade", "coingecko", "fred")))))
    return asked.select("provider", "today", requests.default_window(F.col("provider"), F.col("today")).alias("w")).select("provider", "today", "w.first", "w.last")


# Joins, geography, sets


@query(_values("alias, provider, series_id, changed", "'furniture', 'orders', 'FURNITURE', 'title'", "'household', 'orders', 'HOUSEHOLD', 'unit'", "'machinery', 'orders', 'MACHINERY', 'variable'"))
def metadata_changes(spark, sf):
    old = tables.variables(spark).filter("alias <> 'machinery'")
    new = tables.variables(spark).withColumn("title", F.when(F.col("alias") == "furniture", "other").otherwise(F.col("title"))).withColumn("unit", F.when(F.col("alias") == "household", "index").otherwise(F.col("unit")))
    return diff.metadata_changes(old, new)


@query("SELECT p_partkey, list_filter([CASE WHEN p_name LIKE 'red %' THEN 'colour' END, CASE WHEN p_name LIKE '% ring' AND p_name <> 'red ring' THEN 'jewel' END], lambda x: x IS NOT NULL) AS found FROM (SELECT p_partkey, p_name FROM part) WHERE p_name <> 'red ring' UNION ALL SELECT p_partkey, ['pair'] FROM part WHERE p_name = 'red ring'")
def phrase_mentions(spark, sf):
    """The longest name takes its place, so a part of it is not found again."""
    return tables.read(spark, sf, "part").select("p_partkey", requests.mentions(F.col("p_name"), {"red": "colour", "ring": "jewel", "red ring": "pair"}).alias("found"))


@query("SELECT 'R' || n_regionkey AS code, n_name AS member FROM nation")
def region_members(spark, sf):
    """Regions of a vocabulary to their members; a country is its own."""
    n = tables.read(spark, sf, "nation").orderBy("n_nationkey").collect()  # a vocabulary is made on the driver
    regions = {f"R{k}": ([f"Region {k}"], [r.n_name for r in n if r.n_regionkey == k]) for k in {r.n_regionkey for r in n}}
    words = vocabulary.Vocabulary({}, {}, regions, {}, {}, {}, [], [])
    return geography.expand(requests.geographies(words)).select("code", "member")


@query("SELECT o_custkey, list_sort(list_filter(list_distinct(list(o_orderpriority)), lambda x: x <> '5-LOW')) AS after, list_sort(list_filter(list_distinct(list(o_orderpriority)), lambda x: x NOT IN ('1-URGENT', '2-HIGH'))) AS others FROM orders GROUP BY o_custkey")
def follow_up_lists(spark, sf):
    have = tables.read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("c"))
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    after = geography.follow_up(F.col("c"), F.slice("c", 1, 1), strings("5-LOW"))
    return have.select("o_custkey", F.array_sort(after).alias("after"), F.array_sort(geography.code_difference(F.col("c"), strings("1-URGENT", "2-HIGH"))).alias("others"))


@query(OBS + " SELECT series_id, period, geography, value, (CASE WHEN series_id = 'BUILDING' THEN 0 ELSE 281474976710656 END + obs_seq)::BIGINT AS obs_seq FROM obs WHERE series_id IN ('BUILDING', 'MACHINERY')")
def appended_series(spark, sf):
    """Observations of a second series come after those of the first."""
    o = tables.observations(spark, sf)
    return dataset.union_all([o.filter("series_id = 'BUILDING'"), o.filter("series_id = 'MACHINERY'")]).select("series_id", "period", "geography", "value", "obs_seq")


# Aggregates


@query("SELECT l_returnflag, count(*)::BIGINT AS count, sum(l_linenumber)::DOUBLE AS sum, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def sum_on_request(spark, sf):
    pick = lambda c, name, total=False: next(x for x in describe.statistics(F.col(c), total=total) if str(x).split(" AS ")[-1].strip("'>` ") == name)
    return tables.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("count"), pick("l_linenumber", "sum", True).cast("double").alias("sum"), F.round(pick("l_quantity", "variance"), 6).alias("variance"))


@query(WIDE + """, g AS (SELECT alias, period, count(value) AS v, count(*) AS n FROM cells GROUP BY ALL) SELECT alias, sum(n)::BIGINT AS total, (sum(n) - sum(v))::BIGINT AS missing, round_even(100.0::DOUBLE * (sum(n) - sum(v)) / sum(n), 2) AS missing_pct,
 min(period) FILTER (WHERE v > 0) AS first_valid, max(period) FILTER (WHERE v > 0) AS last_valid, coalesce(list(period ORDER BY period) FILTER (WHERE v = 0), []) AS missing_periods FROM g GROUP BY alias""")
def missing_detail(spark, sf):
    return missing.detail(_cells(spark, sf))


@query("""SELECT n_regionkey AS region, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT n_name)::BIGINT AS members, CASE WHEN count(DISTINCT n_name) < 5 THEN 'partial: ' || count(DISTINCT n_name) || ' of 5 members' END AS note
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def partial_sums(spark, sf):
    o, c, n = (tables.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("region"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), "n_name", F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    return derive.partial_sums(rows, ["region", "period"], "n_name", 5).withColumn("total", F.col("total").cast("double"))


@query(OBS + ", e AS (SELECT series_id, max(CASE WHEN series_id IN ('BUILDING', 'FURNITURE') THEN 2 ELSE 1 END) AS m, count(value) AS n FROM obs GROUP BY 1), b AS (SELECT series_id FROM e ORDER BY m DESC, n DESC, series_id DESC LIMIT 1) SELECT geography, period, series_id, value FROM obs WHERE series_id IN (SELECT series_id FROM b)")
def default_slice(spark, sf):
    match = F.when(F.col("series_id").isin("BUILDING", "FURNITURE"), 2).otherwise(1)
    return derive.default_slice(tables.observations(spark, sf), "series_id", match).select("geography", "period", "series_id", "value")


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 10 THEN 'base' ELSE 'more' END AS source FROM customer WHERE c_nationkey < 10 OR c_nationkey BETWEEN 10 AND 14")
def coverage_backfill(spark, sf):
    """Rows of a second answer for keys that the first lacks, accepted as more countries are covered."""
    c = tables.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    base = c.filter("c_nationkey < 10").withColumn("source", F.lit("base"))
    more = c.filter("c_nationkey between 5 and 14").withColumn("source", F.lit("more"))
    return derive.backfilled(base, more, ["c_custkey"], 25, "c_nationkey")


@query("SELECT c_custkey, c_nationkey, 'base' AS source FROM customer WHERE c_nationkey < 10")
def coverage_backfill_rejected(spark, sf):
    """A second answer that adds nothing leaves the first as it was."""
    c = tables.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    base = c.filter("c_nationkey < 10").withColumn("source", F.lit("base"))
    return derive.backfilled(base, base.filter("c_nationkey < 3").withColumn("source", F.lit("more")), ["c_custkey"], 25, "c_nationkey")


@query("""WITH v AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice / 100000 END AS v FROM orders), n AS (SELECT o_custkey, list_sort(list(v) FILTER (WHERE abs(v) <= 50)) AS near, min(v) AS low FROM v GROUP BY 1)
 SELECT o_custkey, CASE WHEN len(near) > 0 THEN near[(len(near) // 2 + 1)::INT] ELSE low END AS value FROM n""")
def collapsed_growth(spark, sf):
    rows = tables.read(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 100000).alias("value"))
    return derive.collapse_dates(rows, ["o_custkey"], growth=True)


@query("""WITH s AS (SELECT c_nationkey, c_mktsegment, count(*)::HUGEINT AS n FROM customer GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS everything FROM s), f AS (SELECT *, (n * 1000) % everything AS rest, (n * 1000) // everything AS floored FROM (SELECT c_nationkey, c_mktsegment, n, everything::HUGEINT AS everything FROM t) WHERE everything > 1000 UNION ALL SELECT c_nationkey, c_mktsegment, n, everything::HUGEINT, 0, n FROM t WHERE everything <= 1000),
 r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, c_nationkey DESC, c_mktsegment DESC) AS place, 1000 - sum(floored) OVER () AS more FROM f) SELECT c_nationkey, c_mktsegment, (floored + CASE WHEN place <= more AND rest > 0 THEN 1 ELSE 0 END)::BIGINT AS places FROM r""")
def stratified_allocation(spark, sf):
    """A thousand places for the strata of customers by nation and segment."""
    strata = tables.read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return survey_stats.allocate(strata, ["c_nationkey", "c_mktsegment"], "n", 1000)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y')::INT AS year, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN quarter(o_orderdate)::INT ELSE month(o_orderdate)::INT * 100 + day(o_orderdate)::INT END AS sub FROM orders")
def period_order(spark, sf):
    k, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    label = F.when(k == 0, F.left(day, F.lit(4))).when(k == 1, F.concat(F.left(day, F.lit(4)), F.lit("Q"), F.quarter("o_orderdate"))).otherwise(day)
    return tables.read(spark, sf, "orders").select("o_orderkey", periods.period_key(label).alias("k")).select("o_orderkey", "k.year", "k.sub")


@query("WITH v AS (SELECT o_custkey, (max(o_orderkey) % 3)::DOUBLE AS value FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value, o_custkey DESC) AS rank FROM v) SELECT rank::INT AS rank, o_custkey, value FROM r WHERE rank <= 15")
def bottom_n_ties(spark, sf):
    """Ascending ranks put the later key first among equal values."""
    v = tables.read(spark, sf, "orders").groupBy("o_custkey").agg((F.max("o_orderkey") % 3).cast("double").alias("value")).withColumn("period", F.lit("2000"))
    return derive.top_n(v, ["o_custkey"], 15, ascending=True).select("rank", "o_custkey", "value")


# Validation

_OBS_ROWS = [
    ("p", "dup", "A", "AAA", "2000", 1.0, "%", "annual", None), ("p", "dup", "A", "AAA", "2000", 2.0, "%", "annual", None),
    ("p", "bad", "A", "AAA", "2020-W05", 1.0, "%", "annual", None), ("p", "nan", "A", "AAA", "2000", float("nan"), "%", "annual", None), ("p", "nan", "A", "AAA", "2001", 1.0, "%", "annual", None),
    ("p", "mix", "A", "AAA", "2000", 1.0, "%", "annual", None), ("p", "mix", "A", "AAA", "2000-05", 1.0, "%", "monthly", None),
    ("p", "units", "A", "AAA", "2000", 1.0, "%", "annual", None), ("p", "units", "A", "AAA", "2001", 1.0, "index", "annual", None),
    ("p", "level", "A", "AAA", "2000", 1.0, "current us$", "annual", "E"),
    ("p", "void", "A", "AAA", "2000", None, "%", "annual", None), ("p", "thin", "A", "AAA", "2000", None, "%", "annual", None), ("p", "thin", "A", "AAA", "2001", None, "%", "annual", None), ("p", "thin", "A", "AAA", "2002", 1.0, "%", "annual", None),
    *(("p", "gap", "A", "AAA", str(y), 1.0, "%", "annual", None) for y in (2000, 2001, 2002, 2005)), *(("p", "jump", "A", "AAA", str(2000 + i), v, "%", "annual", "P") for i, v in enumerate((1.0, 1.1, 0.9, 1.0, 1.2, 50.0))),
]


def _planted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every fault once for each region, whose key ends the series' codes."""
    regions = tables.read(spark, sf, "region").select("r_regionkey")
    named = lambda c: F.concat(F.col(c), F.lit("_"), F.col("r_regionkey").cast("string"))
    obs = spark.createDataFrame([(*r, i) for i, r in enumerate(_OBS_ROWS)], OBSERVATIONS)
    names = [*dict.fromkeys(r[1] for r in _OBS_ROWS), "never"]
    concept = {"units": "c", "level": "c"}
    rows = spark.createDataFrame([(n, "p", n, n, "%", "annual", concept.get(n), None, i) for i, n in enumerate(names)], "alias string, provider string, series_id string, title string, unit string, frequency string, concept string, coverage_end string, ordinal int")
    both = [x.withColumn("r_regionkey", F.explode(F.array(*(F.lit(r.r_regionkey) for r in regions.collect())))) for x in (obs, rows)]  # a number a region
    obs, rows = both[0].withColumn("series_id", named("series_id")), both[1].withColumns({c: named(c) for c in ("alias", "series_id", "title", "concept")})
    return obs.drop("r_regionkey"), rows.drop("r_regionkey")


@query("WITH v AS (" + _values("code, severity, variable", "'duplicate_key', 'error', 'p:dup'", "'invalid_period', 'error', 'p:bad'", "'non_numeric_value', 'error', 'nan'", "'mixed_frequency', 'error', 'mix'", "'unit_conflict', 'error', 'units'", "'incompatible_units_same_concept', 'warning', 'c'", "'missing_variable', 'error', 'never'",
    "'all_values_missing', 'error', 'void'", "'sparse_variable', 'warning', 'thin'", "'time_gap', 'warning', 'gap'", "'extreme_jump', 'info', 'jump'", "'provider_flag', 'info', NULL", "'provider_flag', 'info', NULL", "'frequency_not_available', 'warning', 'bad'",
    *[f"'coverage_ends_early', 'warning', '{n}'" for n in ("dup", "bad", "nan", "mix", "units", "level", "thin")]) + ") SELECT code, severity, variable || '_' || r_regionkey AS variable FROM v, region WHERE variable IS NOT NULL UNION ALL FROM v WHERE variable IS NULL")
def validation_rules(spark, sf):
    """Observations with every fault planted once a region: each rule finds its own."""
    return validate.validate(*_planted(spark, sf), "annual", 2005).filter("not (code = 'coverage_ends_early' and (variable like 'gap%' or variable like 'jump%'))").select("code", "severity", "variable")


_PLANTED = OBS + """, o AS (SELECT series_id, geography, period, right(period, 2) AS m, value, status FROM obs),
 p AS (SELECT 'nan' AS alias, 'AUTOMOBILE' AS s, 1 AS i UNION ALL SELECT 'units', 'BUILDING', 2 UNION ALL SELECT 'void', 'FURNITURE', 3 UNION ALL SELECT 'thin', 'HOUSEHOLD', 4 UNION ALL SELECT 'mix', 'MACHINERY', 5),
 kept AS (SELECT * FROM o WHERE NOT (series_id = 'AUTOMOBILE' AND m = '05')),
 months AS (SELECT series_id, geography, 12 * left(period, 4)::INT + m::INT AS slot FROM (FROM kept WHERE NOT (series_id = 'BUILDING' AND m = '07') UNION ALL FROM kept WHERE series_id = 'HOUSEHOLD' AND m = '03')),
 gaps AS (SELECT series_id, geography FROM months WHERE series_id <> 'MACHINERY' GROUP BY ALL HAVING count(*) >= 3 AND max(slot) - min(slot) + 1 > count(*))
 SELECT 'duplicate_key' AS code, 'error' AS severity, 'orders:HOUSEHOLD' AS variable, count(*)::BIGINT AS issues FROM kept WHERE series_id = 'HOUSEHOLD' AND m = '03'
 UNION ALL SELECT 'invalid_period', 'error', 'orders:BUILDING', 1 WHERE EXISTS (FROM kept WHERE series_id = 'BUILDING' AND m = '07')
 UNION ALL SELECT 'non_numeric_value', 'error', 'nan', 1 WHERE EXISTS (FROM kept WHERE series_id = 'AUTOMOBILE' AND m = '02')
 UNION ALL SELECT 'mixed_frequency', 'error', 'mix', 1 WHERE EXISTS (FROM kept WHERE series_id = 'MACHINERY' AND m = '09')
 UNION ALL SELECT 'unit_conflict', 'error', 'units', 1 WHERE EXISTS (FROM kept WHERE series_id = 'BUILDING' AND m = '04')
 UNION ALL SELECT 'incompatible_units_same_concept', 'warning', 'sales', 1
 UNION ALL SELECT 'missing_variable', 'error', 'never', 1
 UNION ALL SELECT 'all_values_missing', 'error', 'void', 1
 UNION ALL SELECT 'sparse_variable', 'warning', 'thin', 1 WHERE (SELECT count(*) FILTER (WHERE m IN ('03', '04')) * 1.0 / count(*) FROM (FROM kept WHERE series_id = 'HOUSEHOLD' UNION ALL FROM kept WHERE series_id = 'HOUSEHOLD' AND m = '03')) BETWEEN 0.0001 AND 0.4999
 UNION ALL SELECT 'time_gap', 'warning', alias, count(*)::BIGINT FROM gaps JOIN p ON s = series_id GROUP BY alias"""


@query(_PLANTED)
def validation_planted(spark, sf):
    """Faults planted into the observations by rules over segment and month; every rule finds its own, counted by code and variable."""
    o = tables.observations(spark, sf).withColumn("m", F.right("period", F.lit(2)))
    is_ = lambda s, *m: (F.col("series_id") == s) & (F.col("m").isin(*m) if m else F.lit(True))
    o = o.filter(~is_("AUTOMOBILE", "05"))
    o = o.unionByName(o.filter(is_("HOUSEHOLD", "03")))
    value = F.when(is_("AUTOMOBILE", "02"), F.lit(float("nan"))).when(is_("FURNITURE") | (is_("HOUSEHOLD") & ~F.col("m").isin("03", "04")), F.lit(None).cast("double")).otherwise(F.col("value"))
    period = F.when(is_("BUILDING", "07"), F.concat(F.lit("about "), "period")).when(is_("MACHINERY", "09"), F.concat(F.left("period", F.lit(4)), F.lit("Q3"))).otherwise(F.col("period"))
    unit = F.when(is_("BUILDING", "04"), "thousands").when(is_("MACHINERY"), "percent").otherwise(F.col("unit"))
    o = o.withColumns({"value": value, "period": period, "unit": unit}).drop("m")
    named = {"nan": ("AUTOMOBILE", "sales"), "units": ("BUILDING", None), "void": ("FURNITURE", None), "thin": ("HOUSEHOLD", None), "mix": ("MACHINERY", "sales"), "never": ("NONE", None)}
    v = spark.createDataFrame([(a, "orders", s, a, None, "monthly", c, None, i) for i, (a, (s, c)) in enumerate(named.items())], VARIABLES)
    issues = validate.validate(o, v).filter(~F.col("code").isin("extreme_jump", "provider_flag") & ~((F.col("code") == "time_gap") & (F.col("variable") == "mix")))
    return issues.groupBy("code", "severity", "variable").agg(F.count(F.lit(1)).alias("issues"))


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS e, count(*) FILTER (WHERE o_orderstatus = 'O') AS w, count(*) FILTER (WHERE o_orderstatus = 'P') AS i FROM orders GROUP BY 1)
 SELECT sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, sum(i)::BIGINT AS infos, CASE WHEN sum(e) > 0 THEN 'unusable' WHEN sum(w) > 0 THEN 'usable_with_warnings' ELSE 'clean' END AS status FROM o""")
def validation_verdict_of_orders(spark, sf):
    """The roll-up over issues made from order states."""
    o = tables.read(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").when(F.col("o_orderstatus") == "P", "info")
    return validate.verdict(o.select(kind.alias("severity")).filter("severity is not null"))


@query("SELECT 7 * count(*)::BIGINT AS errors, 3 * count(*)::BIGINT AS warnings, count(*)::BIGINT + 2 AS infos, 'unusable' AS status FROM region")
def validation_verdict(spark, sf):
    return validate.verdict(validate.validate(*_planted(spark, sf)))


@query(WIDE + """, t AS (SELECT 'time_gap' AS code, 'warning' AS severity FROM obs GROUP BY series_id, geography HAVING count(*) >= 3 AND max(left(period, 4)::INT * 12 + right(period, 2)::INT) - min(left(period, 4)::INT * 12 + right(period, 2)::INT) + 1 > count(*)),
 e AS (SELECT 'coverage_ends_early', 'warning' FROM obs GROUP BY series_id, geography HAVING max(left(period, 4)::INT) < 1999), f AS (SELECT DISTINCT 'frequency_not_available', 'warning', series_id FROM obs), p AS (SELECT DISTINCT 'provider_flag', 'info', status FROM obs),
 m AS (SELECT *, median(value) OVER w AS med, count(*) OVER w AS n FROM obs WINDOW w AS (PARTITION BY series_id, geography)), d AS (SELECT *, median(abs(value - med)) OVER w AS mad, avg(abs(value - med)) OVER w AS mean FROM m WINDOW w AS (PARTITION BY series_id, geography)),
 j AS (SELECT 'extreme_jump', 'info' FROM d WHERE n >= 5 AND abs(CASE WHEN mad > 0 THEN 0.6745 * (value - med) / mad ELSE (value - med) / nullif(1.253314 * mean, 0) END) >= 3.5)
 SELECT code, severity, count(*)::BIGINT AS issues FROM (SELECT * FROM t UNION ALL SELECT * FROM e UNION ALL SELECT f.* EXCLUDE series_id FROM f UNION ALL SELECT p.* EXCLUDE status FROM p UNION ALL SELECT * FROM j) x(code, severity) GROUP BY ALL""")
def validation_issues(spark, sf):
    issues = _dataset(spark, sf).validate("annual", 1999)
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query("""WITH r AS (SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN -p_size ELSE p_retailprice END AS v FROM part), x AS (SELECT *, v BETWEEN -100 AND 15 AS inside, v < 0 AS neg, (v * 0.01 BETWEEN -100 AND 15) OR (v * 100 BETWEEN -100 AND 15) OR (v * 0.001 BETWEEN -100 AND 15) AS hint FROM r),
 s AS (SELECT p_brand, count(*) FILTER (WHERE neg) AS signs, sum(CASE WHEN hint AND NOT neg THEN 1 ELSE 2 END) AS penalty FROM x WHERE NOT inside OR neg GROUP BY 1) SELECT p_brand, signs::BIGINT AS signs, greatest(0, 10 - penalty)::DOUBLE / 10 AS confidence FROM s""")
def sign_checks(spark, sf):
    ranges = spark.createDataFrame([("rate", -100.0, 15.0, False)], "kind string, low double, high double, signed boolean")
    rows = tables.read(spark, sf, "part").withColumn("value", F.when(F.col("p_partkey") % 4 == 0, -F.col("p_size")).otherwise(F.col("p_retailprice")).cast("double"))
    checked = validate.range_checks(rows, ranges, F.lit("rate"))
    signs = checked.groupBy("p_brand").agg(F.count_if("sign_error").alias("signs"))
    return signs.join(validate.confidence(checked, ["p_brand"]), "p_brand")


# Scalars


@query("""WITH r AS (SELECT DISTINCT unnest([strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate), year(o_orderdate) || '-M' || month(o_orderdate), CASE o_orderstatus WHEN 'F' THEN 'Quarterly' WHEN 'O' THEN ' m ' ELSE 'A' END, CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '2-HIGH' THEN 'trimestriel' ELSE o_orderpriority END]) AS raw FROM orders)
 SELECT raw, CASE raw WHEN 'Quarterly' THEN 'quarterly' WHEN 'trimestriel' THEN 'quarterly' WHEN ' m ' THEN 'monthly' WHEN 'A' THEN 'annual' ELSE 'unknown' END AS coerced, CASE raw WHEN 'A' THEN 'annual' WHEN ' m ' THEN 'monthly' WHEN '' THEN 'annual' ELSE raw END AS label, CASE WHEN raw LIKE '____-Q_' THEN 'Q' WHEN raw LIKE '____-M%' THEN 'M' ELSE 'A' END AS guessed FROM r""")
def frequency_names(spark, sf):
    """Spellings of frequencies and period labels made from orders."""
    day, status, priority = F.col("o_orderdate"), F.col("o_orderstatus"), F.col("o_orderpriority")
    label = lambda mark, part: F.concat(F.year(day).cast("string"), F.lit(mark), part.cast("string"))
    spelled = F.when(status == "F", "Quarterly").when(status == "O", " m ").otherwise("A")
    df = tables.read(spark, sf, "orders").select(F.explode(F.array(label("-Q", F.quarter(day)), label("-M", F.month(day)), spelled, F.when(priority == "5-LOW", "").when(priority == "2-HIGH", "trimestriel").otherwise(priority))).alias("raw")).distinct()
    return df.select("raw", periods.coerce_frequency(F.col("raw")).alias("coerced"), periods.frequency_label(F.col("raw")).alias("label"), periods.frequency_from_period(F.col("raw")).alias("guessed"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'percent' WHEN 1 THEN 'index' WHEN 2 THEN 'current_usd' WHEN 3 THEN 'lcu' WHEN 4 THEN 'people' END AS family, CASE WHEN p_partkey % 6 = 2 THEN p_size / 1000.0 ELSE p_size END::DOUBLE AS billions, (p_size * 1000 + 0.5)::DOUBLE AS parsed FROM part")
def units_and_numbers(spark, sf):
    k = F.col("p_partkey") % 6
    unit = F.when(k == 0, "annual %").when(k == 1, "Index 2015 = 100").when(k == 2, "current US$").when(k == 3, "local currency").when(k == 4, "number of persons").otherwise("tonnes")
    size = F.col("p_size").cast("double")
    money = values.to_billions(size, F.when(k == 2, "dollars").otherwise("index"), F.lit(6))
    return tables.read(spark, sf, "part").select("p_partkey", values.unit_family(unit).alias("family"), money.alias("billions"), values.numeric_parse(F.concat(F.lit(" "), F.format_number(size * 1000 + 0.5, 1))).alias("parsed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def epoch_to_iso(spark, sf):
    return tables.read(spark, sf, "events").select("event_id", values.epoch_ms_to_iso(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))


@query("SELECT p_partkey, p_brand || '. ' || p_name || ' [P' || p_partkey || ']' || CASE WHEN p_size % 2 = 0 THEN '. Unit: US$' ELSE '' END || '. http://x/' || p_partkey || '. Retrieved 2024-01-31.' AS quoted FROM part")
def citations(spark, sf):
    unit = F.when(F.col("p_size") % 2 == 0, "US$").otherwise("")
    return tables.read(spark, sf, "part").select("p_partkey", text.citation(F.col("p_brand"), F.col("p_name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")), unit, F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")), F.lit("2024-01-31")).alias("quoted"))


@query("SELECT p_brand, list_transform(list(p_partkey ORDER BY p_partkey), lambda x: CASE WHEN x % 8 < 3 THEN 0 WHEN x % 8 < 6 THEN 1 ELSE 2 END) AS axes FROM part GROUP BY 1 HAVING len(list_distinct(list_transform(list(p_partkey), lambda x: x % 8))) = 8")
def axis_buckets(spark, sf):
    """Series on up to two orders of magnitude share an axis."""
    each = tables.read(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list("p_partkey")).alias("k"), F.count_distinct(F.col("p_partkey") % 8).alias("d")).filter("d = 8")
    return each.select("p_brand", values.axis_buckets(F.transform("k", lambda x: (x % 8).cast("int"))).alias("axes"))


@query("SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 3, 4) THEN NULL WHEN event_id % 7 = 5 THEN value END AS value FROM events")
def sanitised_values(spark, sf):
    k = F.col("event_id") % 7
    raw = F.when(k == 0, "NaN").when(k == 1, " . ").when(k == 2, "n/a").when(k == 3, "inf").when(k == 4, "text").when(k == 5, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise("")
    return tables.read(spark, sf, "events").select("event_id", values.sanitise(raw).alias("value"))


# Cubes


@query("WITH g AS (SELECT o_orderpriority AS age, o_orderstatus AS sex, count(*) FILTER (WHERE o_totalprice > 100000) AS points, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT age, sex, points::BIGINT AS points FROM g ORDER BY points DESC, (age = '5-LOW') DESC, first LIMIT 1")
def best_covered_slice(spark, sf):
    o = tables.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("age"), F.col("o_orderstatus").alias("sex"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("value"), "o_orderkey")
    return cube.best_covered_slice(o, ["age", "sex"], (F.col("age") == "5-LOW").cast("int"), "o_orderkey").select("age", "sex", "points")


@query("SELECT p_brand, coalesce(min('TOTAL') FILTER (WHERE p_type = 'PROMO'), arg_min(p_type, p_partkey)) AS code FROM part GROUP BY 1")
def default_members(spark, sf):
    p = tables.read(spark, sf, "part").select(F.col("p_brand").alias("dimension"), F.when(F.col("p_type") == "PROMO", "TOTAL").otherwise(F.col("p_type")).alias("code"), F.col("p_partkey").alias("place"))
    return cube.default_member(p).select(F.col("dimension").alias("p_brand"), F.col("default_code").alias("code"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type IN ('PROMO', 'ECONOMY')")
def strict_members(spark, sf):
    return cube.strict_filter(tables.read(spark, sf, "part"), "p_type", ["PROMO", "ECONOMY"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END)::INT AS score FROM part")
def aggregate_scores(spark, sf):
    key = F.array(F.when(F.col("p_partkey") % 2 == 0, "Total").otherwise("x"), F.when(F.col("p_size") % 3 == 0, "_T").otherwise("F"), F.lit("D"))
    return tables.read(spark, sf, "part").select("p_partkey", cube.aggregate_score(key).alias("score"))


@query("WITH m AS (SELECT n_regionkey, list(n_name) AS members FROM nation GROUP BY 1), c AS (SELECT c_mktsegment AS segment, n_regionkey, list(DISTINCT n_name) AS asked FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 OR n_regionkey = 1 GROUP BY ALL) SELECT segment, n_regionkey AS region, len(asked) >= 5 AND len(asked) / len(members)::DOUBLE >= 0.85 AS whole FROM c JOIN m USING (n_regionkey)")
def region_substitution(spark, sf):
    n, c = tables.read(spark, sf, "nation"), tables.read(spark, sf, "customer")
    members = n.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("members"))
    asked = c.join(n, c.c_nationkey == n.n_nationkey).filter("c_acctbal > 9000 or n_regionkey = 1").groupBy(F.col("c_mktsegment").alias("segment"), "n_regionkey").agg(F.collect_set("n_name").alias("asked"))
    return asked.join(members, "n_regionkey").select("segment", F.col("n_regionkey").alias("region"), cube.covers_region(F.col("asked"), F.col("members")).alias("whole"))


# Requests and recipes

def _words(spark: SparkSession, sf: str) -> vocabulary.Vocabulary:
    """A vocabulary made from the tables: segments as concepts, nations and regions as places."""
    nations, regions = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    segments = tables.read(spark, sf, "customer").select(F.lower("c_mktsegment").alias("key")).distinct()
    concepts = segments.select("key", F.lit("en").alias("language"), F.col("key").alias("name")).unionByName(segments.select("key", F.lit("fr").alias("language"), F.concat(F.lit("secteur "), "key").alias("name")))
    countries = nations.select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    areas = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("code"), F.col("r_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("member"))
    return vocabulary.from_tables(concepts, countries, areas, frequencies={"quarterly": ["quarterly", "trimestriel"], "monthly": ["monthly"]}, providers={"orders": ["order book"]}, formats={"csv": ["csv"]}, long_shape=["long"], ambiguous=["building"])


@query("""WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS s, 'N' || n_nationkey AS code, n_regionkey, c_custkey % 4 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
 m AS (SELECT n_regionkey, list_sort(list('N' || n_nationkey)) AS members FROM nation GROUP BY 1)
 SELECT c_custkey, CASE WHEN k = 3 THEN 'fr' ELSE 'en' END AS language, s AS concepts, CASE WHEN k = 1 THEN array_to_string(members, ',') ELSE code END AS geographies,
  CASE k WHEN 0 THEN 1994 WHEN 1 THEN 2025 - (c_custkey % 9) WHEN 3 THEN 1995 END::INT AS start, CASE k WHEN 0 THEN 1996 WHEN 1 THEN 2025 END::INT AS "end", CASE k WHEN 0 THEN 'quarterly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'quarterly' ELSE 'annual' END AS frequency,
  CASE WHEN k = 2 THEN 'orders' ELSE '' END AS providers, CASE WHEN k = 2 THEN 'long' ELSE 'wide' END AS shape, CASE WHEN k = 0 THEN 'csv' ELSE 'xlsx' END AS formats, CASE WHEN s = 'building' THEN s ELSE '' END AS ambiguous FROM c JOIN m USING (n_regionkey)""")
def parsed_requests(spark, sf):
    """A request for each customer, in four wordings, read against a vocabulary made from the tables."""
    c = tables.read(spark, sf, "customer").join(tables.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(tables.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, s = F.col("c_custkey") % 4, F.initcap("c_mktsegment")
    text = (
        F.when(k == 0, F.concat(s, F.lit(" of "), "n_name", F.lit(" from 1994 to 1996, quarterly, as csv")))
        .when(k == 1, F.concat(s, F.lit(" for "), F.initcap("r_name"), F.lit(" over the last "), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit(" years")))
        .when(k == 2, F.concat(F.lit("monthly "), s, F.lit(" in "), "n_name", F.lit(" from the order book, long")))
        .otherwise(F.concat(F.lit("données trimestriel du secteur "), s, F.lit(" pour "), "n_name", F.lit(" depuis 1995")))
    )
    got = requests.parse_requests(c.select("c_custkey", text.alias("text")), _words(spark, sf), current_year=2025)
    return got.select("c_custkey", "language", *(F.array_join(x, ",").alias(x) for x in ("concepts", "geographies")), "start", "end", "frequency", F.array_join("providers", ",").alias("providers"), "shape", F.array_join("formats", ",").alias("formats"), F.array_join("ambiguous", ",").alias("ambiguous"))


@query("""SELECT p_partkey, p_size::INT AS n, greatest(1990 + p_size % 30, 1990 + p_size % 7)::INT AS year FROM part""")
def ranks_asked_for(spark, sf):
    """How many ranks, and of which year, the sentences about parts ask for."""
    top, year = F.udf(lambda t: requests.top_count(t), "int"), F.udf(lambda t: requests.target_year(t), "int")
    size = F.col("p_size")
    text = F.concat(F.lit("top "), size.cast("string"), F.lit(" "), "p_name", F.lit(" in "), (1990 + size % 30).cast("string"), F.lit(" or "), (1990 + size % 7).cast("string"))
    return tables.read(spark, sf, "part").select("p_partkey", top(text).alias("n"), year(text).alias("year"))


@query("""WITH c AS (SELECT o_orderkey, list_sort(list(DISTINCT n_name)) AS asked FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <= 1 GROUP BY 1),
 m AS (SELECT list(n_name) FILTER (WHERE n_regionkey = 0) AS zero, list(n_name) FILTER (WHERE n_nationkey = 1) AS one FROM nation), a AS (SELECT o_orderkey, coalesce(asked, []) AS asked FROM orders LEFT JOIN c USING (o_orderkey))
 SELECT o_orderkey, p AS provider, list_filter(CASE p WHEN 'a' THEN ['b', 'd'] WHEN 'b' THEN ['a'] ELSE [] END, lambda x: x <> CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 'b' END) AS fallback
 FROM (SELECT o_orderkey, CASE WHEN len(asked) = 0 THEN 'a' WHEN list_has_all(one, asked) THEN 'c' WHEN list_has_all(zero, asked) THEN 'b' ELSE 'a' END AS p FROM a, m)""")
def provider_choice(spark, sf):
    """For each order the provider that covers the nations of two regions among its suppliers, and which to try after it."""
    orders, items, s, n = (tables.read(spark, sf, t) for t in ("orders", "lineitem", "supplier", "nation"))
    names = n.select("n_nationkey", "n_name", "n_regionkey").collect()  # the offers' countries
    offers = [{"provider": "a", "confidence": 0.8, "scope": "global"}, {"provider": "b", "confidence": 0.75, "scope": "list", "countries": [r.n_name for r in names if r.n_regionkey == 0]}, {"provider": "c", "confidence": 0.86, "scope": "single", "countries": [r.n_name for r in names if r.n_nationkey == 1]}]
    few = n.filter("n_regionkey <= 1")
    asked = items.join(s, items.l_suppkey == s.s_suppkey).join(few, s.s_nationkey == few.n_nationkey).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("n_name").alias("countries"))
    rows = orders.select("o_orderkey").join(asked, "o_orderkey", "left").withColumn("provider", requests.choose_provider(offers, F.col("countries")))
    covers = F.when(F.col("o_orderkey") % 2 == 0, F.array(*map(F.lit, "abc"))).otherwise(F.array(*map(F.lit, "acd")))
    return rows.select("o_orderkey", "provider", requests.fallback_order(F.col("provider"), {"a": ["b", "a", "c2", "b", "d"], "b": ["a", "b"]}, covers).alias("fallback"))


@query("""SELECT 'concepts' AS kind, count(DISTINCT c_mktsegment)::BIGINT AS n FROM customer UNION ALL SELECT 'countries', count(*)::BIGINT FROM nation UNION ALL SELECT 'regions', count(DISTINCT n_regionkey)::BIGINT FROM nation""")
def vocabulary_lists(spark, sf):
    words = _words(spark, sf)
    g = requests.geographies(words)
    rows = requests.concepts(words).select(F.lit("concepts").alias("kind"), "key").unionAll(g.select(F.when(F.col("kind") == "country", "countries").otherwise("regions"), "code"))
    return rows.groupBy("kind").agg(F.count_distinct("key").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice * l_discount / 7)::DOUBLE AS two, format('{:.1f}', l_quantity / 8)::DOUBLE AS one, format('{:.3f}', l_tax / 16)::DOUBLE AS three FROM lineitem""")
def binary_rounding(spark, sf):
    """Half-even rounding of the doubles themselves, ties (eighths, sixteenths) among them."""
    r = values.round_binary
    return tables.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(F.col("l_extendedprice") * F.col("l_discount") / 7, 2).alias("two"), r(F.col("l_quantity") / 8, 1).alias("one"), r(F.col("l_tax") / 16, 3).alias("three"))


def _selection(spark: SparkSession, sf: str, names: list[str]) -> dict:
    """A dataset of picked series, one of which is not there."""
    o = tables.observations(spark, sf)

    def fetch(series: dict, spec) -> DataFrame:
        if series["series_id"] == "NONE":
            raise OSError("down")
        return o.filter(F.col("series_id") == series["series_id"])

    return requests.from_selection([{"provider": "orders", "series_id": n, "title": f"Orders of {n.lower()}", "unit": "current us$"} for n in names], fetch, [], 1994, 1996)


@query(OBS + " SELECT geography, period, lower('orders_of_' || series_id || '_usd') AS indicator, value FROM obs WHERE series_id IN ('BUILDING', 'MACHINERY') AND left(period, 4) BETWEEN '1994' AND '1996'")
def dataset_from_selection(spark, sf):
    made = _selection(spark, sf, ["BUILDING", "NONE", "MACHINERY"])
    if [f["series"] for f in made["failures"]] != ["orders:NONE"]:
        raise AssertionError(made["failures"])
    return made["dataset"].long().select("geography", "period", "indicator", "value")


@query(OBS + " SELECT geography AS geo_key, period, max(value) FILTER (WHERE series_id = 'BUILDING') AS building_usd, max(value) FILTER (WHERE series_id = 'MACHINERY') AS machinery_usd FROM obs WHERE series_id IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def instant_dataset(spark, sf):
    """From a sentence to a wide dataset: the first series of each concept that can be had."""
    o = tables.observations(spark, sf)
    ranked = {"building": ["GONE", "BUILDING"], "machinery": ["MACHINERY"]}

    def fetch(series: dict, spec) -> DataFrame:
        if series["series_id"] == "GONE":
            raise OSError("down")
        return o.filter(F.col("series_id") == series["series_id"])

    resolve = lambda concept, spec: [{"provider": "orders", "series_id": s, "title": s, "unit": "current us$"} for s in ranked[concept]]
    made = requests.instant("building and machinery in NATION_3", resolve, fetch, _words(spark, sf))
    return made["dataset"].wide().drop("geography")


@query(_values("problems, same, differs, loaded", "'', true, true, true"))
def recipe_round_trip(spark, sf):
    """A recipe read from a dataset: notes change nothing in its hash, steps do, and it survives a file."""
    d = _dataset(spark, sf)
    one, two = recipes.Recipe.of(d, "n", {"request": "text"}, start_year=1994), recipes.Recipe.of(d, "other", start_year=1994)
    other = recipes.Recipe.of(d.filter_periods("1995"), "n", start_year=1994)
    path = Path(tempfile.mkdtemp(prefix="almanack-recipe-")) / "r.json"
    one.save(str(path))
    return spark.createDataFrame([(",".join(one.problems()), one.hash() == two.hash(), one.hash() != other.hash(), recipes.Recipe.load(str(path)).hash() == one.hash())], "problems string, same boolean, differs boolean, loaded boolean")


_DEFINED = WIDE + """, d AS (SELECT '{"end_year":null,"frequency":"annual","geographies":[' || (SELECT string_agg('"' || g || '"', ',' ORDER BY g) FROM (SELECT DISTINCT geography AS g FROM obs)) || '],"output_shape":"wide","preferred_sources":[],"recipe_version":"1.0","series":['
 || (SELECT string_agg('["orders","' || s || '","' || lower(s) || '"]', ',' ORDER BY s) FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) v(s)) || '],"start_year":null,"transformations":[]}' AS text)"""



@query(_DEFINED + """ SELECT left(sha256(text), 16) AS hash, md5('{"params": {"a": ' || (SELECT count(DISTINCT geography) FROM obs) || ', "b": ["x"]}, "provider": "p"}') AS cache_key FROM d""")
def recipe_hash(spark, sf):
    """The hash of a dataset's definition, read from its tables, and the key of a request about it."""
    made = recipes.Recipe.of(_dataset(spark, sf), "n")
    return spark.createDataFrame([(made.hash(), recipes.cache_key("p", {"b": ["x"], "a": len(made.definition["geographies"])}))], "hash string, cache_key string")


@query(_values("alias, provider, series_id, title, unit, frequency, transformations", *(f"'{a}', 'orders', '{a.upper()}', 'Orders of {a}', 'current us$', 'monthly', ['build_dataset', 'filter_periods']" for a in tables.ALIASES)))
def dataset_lineage(spark, sf):
    return _dataset(spark, sf).filter_periods("1995").lineage()


@query(WIDE + " SELECT 'alias' AS part, alias AS name, count(*) FILTER (WHERE value IS NULL)::BIGINT AS missing FROM cells GROUP BY alias UNION ALL SELECT 'geo', geo_key, count(*) FILTER (WHERE value IS NULL)::BIGINT FROM cells GROUP BY geo_key")
def dataset_missingness(spark, sf):
    made = _dataset(spark, sf).missingness()
    return made["variables"].select(F.lit("alias").alias("part"), F.col("alias").alias("name"), "missing").unionAll(made["geographies"].select(F.lit("geo"), "geo_key", "missing"))


@query(WIDE + """, m AS (SELECT alias, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM cells GROUP BY alias) SELECT alias, geo_key, period FROM cells JOIN m USING (alias) WHERE value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1)""")
def dataset_outliers(spark, sf):
    return _dataset(spark, sf).outliers("iqr").select("alias", "geo_key", "period")


@query(WIDE + " SELECT alias, count(value)::BIGINT AS count, round(avg(value), 2) AS mean FROM cells GROUP BY alias")
def dataset_describe(spark, sf):
    return _dataset(spark, sf).describe().select("alias", "count", F.round("mean", 2).alias("mean"))


@query(WIDE + " SELECT alias AS variable, 'numeric' AS kind, count(DISTINCT value)::BIGINT AS \"distinct\", count(*) FILTER (WHERE value IS NULL)::BIGINT AS missing FROM cells GROUP BY alias UNION ALL SELECT 'geo_key', 'text', count(DISTINCT geo_key), 0 FROM wide UNION ALL SELECT 'period', 'text', count(DISTINCT period), 0 FROM wide UNION ALL SELECT 'geography', 'text', count(DISTINCT geo_key), 0 FROM wide")
def dataset_profile(spark, sf):
    return _dataset(spark, sf).profile()[0].select("variable", "kind", "distinct", "missing")


# Exports


def _exported(spark: SparkSession, sf: str, fmt: str, name: str) -> str:
    path = str(Path(tempfile.mkdtemp(prefix="almanack-export-")) / name)
    exports.export(_dataset(spark, sf), fmt, path)
    return path


_BACK = WIDE + " SELECT geo_key, period, building, machinery FROM wide"
_SCHEMA = "geo_key string, period string, building double, machinery double"


def _rows(spark: SparkSession, rows: list) -> DataFrame:
    none = lambda x: None if x is None or x == "" or x != x else float(x)
    return spark.createDataFrame([(r["geo_key"], r["period"], none(r["building"]), none(r["machinery"])) for r in rows], _SCHEMA)


@query(_BACK)
def export_json(spark, sf):
    return _rows(spark, json.loads(Path(_exported(spark, sf, "json", "d.json")).read_text())["data"])


@query(_BACK)
def export_feather(spark, sf):
    from pyarrow import feather

    return _rows(spark, feather.read_table(_exported(spark, sf, "feather", "d.feather")).to_pylist())


@query(_BACK)
def export_stata(spark, sf):
    import pandas as pd

    return _rows(spark, pd.read_stata(_exported(spark, sf, "dta", "d.dta")).to_dict("records"))


@query(_BACK)
def export_workbook(spark, sf):
    """The first of the workbook's eight sheets, read back from its XML."""
    import re
    import zipfile

    with zipfile.ZipFile(_exported(spark, sf, "xlsx", "d.xlsx")) as z:
        if len([n for n in z.namelist() if "worksheets" in n]) != 8:
            raise AssertionError("eight sheets expected")
        rows = re.findall("<row>(.*?)</row>", z.read("xl/worksheets/sheet1.xml").decode())
    cells = [[re.sub("<[^>]*>", "", c) for c in re.findall(r"<c[^>]*?/>|<c.*?</c>", r)] for r in rows]
    return _rows(spark, [dict(zip(cells[0], r, strict=True)) for r in cells[1:]])


@query(_BACK)
def export_bundle(spark, sf):
    import csv
    import io
    import zipfile

    with zipfile.ZipFile(_exported(spark, sf, "bundle", "d.zip")) as z:
        return _rows(spark, list(csv.DictReader(io.StringIO(z.read("data.csv").decode()))))


@query(WIDE + ", g AS (SELECT alias, geo_key, value IS NULL AS gap, row_number() OVER (PARTITION BY alias, geo_key ORDER BY period) AS i FROM cells), r AS (SELECT *, gap AND NOT coalesce(lag(gap) OVER w, true) OR (NOT gap AND lead(gap) OVER w IS NULL) AS ends FROM g WINDOW w AS (PARTITION BY alias, geo_key ORDER BY i)) SELECT count(*) FILTER (WHERE ends)::BIGINT AS lines FROM r")
def export_report(spark, sf):
    """Lines of the report's charts: each is broken where a period has no value."""
    return spark.createDataFrame([(Path(_exported(spark, sf, "html", "d.html")).read_text().count("<polyline"),)], "lines long")


@query(_DEFINED + " SELECT left(sha256(text), 16) AS yaml, left(sha256(text), 16) AS json FROM d")
def export_recipes(spark, sf):
    """The hashes of recipes read back from their files; a file of YAML is one of JSON too, as which it is read here."""
    back = {}
    for fmt in ("yaml", "json"):
        text = Path(_exported(spark, sf, f"recipe_{fmt}", f"r.{fmt}"))
        back[fmt] = recipes.Recipe.load(str(text.rename(text.with_suffix(".json")))).hash()
    return spark.createDataFrame([(back["yaml"], back["json"])], "yaml string, json string")


@query(WIDE + " SELECT geo_key, period, building FROM wide")
def export_tables(spark, sf):
    path = landing.folder(spark, "export")
    exports.export(_dataset(spark, sf), "csv", f"{path}/csv")
    exports.export(_dataset(spark, sf), "parquet", f"{path}/parquet")
    csv = spark.read.option("header", True).csv(f"{path}/csv")
    return spark.read.parquet(f"{path}/parquet").join(csv.select("geo_key", "period"), ["geo_key", "period"], "left_semi").select("geo_key", "period", "building")


# Streams


@query(ANNUAL + " SELECT 'N' || v AS version, count(*)::BIGINT AS rows FROM a, (VALUES (0), (1)) t(v) WHERE (v = 0 AND region < 2) OR (v = 1 AND region >= 2) GROUP BY v")
def versioned_refresh(spark, sf):
    """Two landings of a stream: each becomes a version of its own, and the first stays."""
    root = landing.folder(spark, "refresh")
    rows = annual(spark, sf).select(F.lit("p").alias("provider"), F.lit("T").alias("series_id"), F.col("nation").alias("geography"), F.col("code").alias("iso3"), F.col("year").alias("period"), "value", F.lit("$").alias("unit"), F.lit("annual").alias("frequency"), F.lit(None).cast("string").alias("status"), F.lit(1).cast("long").alias("obs_seq"), "region")
    for part in ("region < 2", "region >= 2"):
        rows.filter(part).drop("region").coalesce(1).write.mode("append").parquet(f"{root}/in")
        streams.refresh(streams.watch(spark, f"{root}/in", OBSERVATIONS), f"{root}/versions", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/versions").groupBy(F.concat(F.lit("N"), F.col("version").cast("string")).alias("version")).agg(F.count(F.lit(1)).alias("rows"))


_CALLS = [("a", t, False) for t in (0, 10, 20, 30, 40)] + [("a", t, ok) for t, ok in ((70, True), (110, True), (115, True), (120, False), (125, True))] + [("b", t, t % 2 == 0) for t in range(0, 9)]
_STATES = ["closed"] * 4 + ["open"] + ["open", "half_open", "closed", "closed", "closed"]
_EXPECTED = (
    "WITH v AS (" + _values("kind, t, state", *(f"'a', {t}, '{s}'" for (_, t, _), s in zip(_CALLS, _STATES, strict=False)), *(f"'b', {t}, 'closed'" for t in range(0, 9)))
    + ") SELECT 'supplier ' || s_suppkey AS provider, s_suppkey::BIGINT + t AS seconds, state FROM supplier JOIN v ON kind = CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END"
)


def _calls(spark: SparkSession, sf: str, rows: list[tuple]) -> DataFrame:
    """Calls to every supplier, from a second of its own on: those of a failing one for even keys, of a working one for odd keys."""
    parts = {k: F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(ok).alias("ok")) for kind, t, ok in rows if kind == k)).cast("array<struct<t:long,ok:boolean>>") for k in "ab"}
    key = F.col("s_suppkey")
    every = tables.read(spark, sf, "supplier").select(key, F.explode(F.when(key % 2 == 0, parts["a"]).otherwise(parts["b"])).alias("c"))
    return every.select(F.concat(F.lit("supplier "), key.cast("string")).alias("provider"), (key + F.col("c.t")).cast("long").alias("seconds"), "c.ok")


@query(_EXPECTED)
def breaker_states(spark, sf):
    """Five failures open a circuit; after a minute two successes close it."""
    return streams.breaker_states(_calls(spark, sf, _CALLS)).select("provider", "seconds", "state")


@query(_EXPECTED)
def breaker_stream(spark, sf):
    """The same over a stream that stops and goes on from its state."""
    root, n = landing.folder(spark, "calls"), len(_CALLS) // 2
    calls = _calls(spark, sf, _CALLS)
    for part in (_CALLS[:n], _CALLS[n:]):
        _calls(spark, sf, part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        query_ = streams.breaker_states(streams.watch(spark, f"{root}/in", calls.schema), timers=False).writeStream.format("parquet").option("checkpointLocation", f"{root}/c").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start()
        query_.awaitTermination()
    return spark.read.parquet(f"{root}/out").filter("ok is not null").select("provider", "seconds", "state")


@query("SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (WHERE role = 'user')::BIGINT AS user_turns, arg_max(role, turn) AS last_role, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def conversation_stream(spark, sf):
    """The fold of every conversation, kept as state while its turns arrive; the stream is stopped and started between them."""
    spark.conf.set(*streams.STATE_STORE)
    root = landing.folder(spark, "turns")
    turns = tables.read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    kept = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/out")
    for part in ("turn % 2 = 0", "turn % 2 = 1"):
        turns.filter(part).write.mode("append").parquet(f"{root}/in")
        out = streams.fold_stream(streams.watch(spark, f"{root}/in", turns.schema)).writeStream.outputMode("update").option("checkpointLocation", f"{root}/c")
        out.foreachBatch(kept).trigger(availableNow=True).start().awaitTermination()
    w = Window.partitionBy("conv_id").orderBy(F.desc("batch"))
    return spark.read.parquet(f"{root}/out").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "batch")


@query("SELECT 'progress' AS event, count(*)::BIGINT AS rows FROM nation")
def stream_progress(spark, sf):
    """A listener that hands on what each batch read."""
    import time

    root, seen = landing.folder(spark, "progress"), []
    listener = streams.Progress(seen.append)
    spark.streams.addListener(listener)
    try:
        tables.read(spark, sf, "nation").select("n_name").coalesce(1).write.parquet(f"{root}/in")
        q = streams.watch(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema).writeStream.format("noop").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):  # events come on a thread of their own
            if any(e["event"] == "ended" for e in seen):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([("progress", sum(e["rows"] for e in seen if e["event"] == "progress" and e["query"] == str(q.id)))], "event string, rows long")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate > DATE '1998-06-01' - INTERVAL 240 HOUR ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def live_datasets(spark, sf):
    registry = tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created"))
    return streams.live_datasets(registry, F.to_timestamp(F.lit("1998-06-01")), 240, 20).select("id")


@query("SELECT event_id AS key, CASE WHEN epoch(TIMESTAMP '2024-02-01') - epoch(ts)::BIGINT <= CASE event_id % 3 WHEN 0 THEN 3600 WHEN 1 THEN 604800 ELSE 86400 END THEN 'fresh' ELSE 'stale' END AS state FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def cache_states(spark, sf):
    k = F.col("event_id") % 3
    entries = tables.read(spark, sf, "events").select(F.col("event_id").alias("key"), F.when(k == 0, "other").when(k == 1, "annual").otherwise("monthly").alias("frequency"), F.col("ts").cast("timestamp").alias("stored"))
    return streams.cache_state(entries, F.to_timestamp(F.lit("2024-02-01"))).select("key", "state")

"""The registered queries over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import periods, text, values
from almanack.operators import cube, dataset, derive, describe, diff, geography, missing, outliers, search, survey_stats, validate, versions
from almanack.plans.registry import query
from almanack.sources import driver_tables as tables
from almanack.sources import landing, sinks
from almanack.streaming import streams

OBS = """
WITH obs AS (
  SELECT 'orders' AS provider, c_mktsegment AS series_id, n_name AS geography, NULL::VARCHAR AS iso3, strftime(o_orderdate, '%Y-%m') AS period,
    sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value, 'current us$' AS unit, 'monthly' AS frequency, min(o_orderstatus) AS status, min(o_orderkey) AS obs_seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, c_mktsegment, strftime(o_orderdate, '%Y-%m')
)"""
WIDE = OBS + """, wide AS (
  SELECT geography AS geo_key, period, """ + ", ".join(f"max(value) FILTER (WHERE series_id = '{s}') AS {s.lower()}" for s in tables.SEGMENTS) + """
  FROM obs GROUP BY geography, period
), cells AS (SELECT geo_key, period, alias, value FROM wide UNPIVOT INCLUDE NULLS (value FOR alias IN (""" + ", ".join(tables.ALIASES) + """)))"""


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.to_wide(tables.observations(spark, sf), tables.variables(spark), tables.ALIASES)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return missing.cells(_wide(spark, sf), tables.ALIASES)


def _r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


@query(OBS + " SELECT geography, iso3, period, lower(series_id) AS indicator, value, unit, frequency, provider, series_id, status FROM obs")
def obs_long_monthly(spark, sf):
    return dataset.to_long(tables.observations(spark, sf), tables.variables(spark))


@query(WIDE + " SELECT geo_key, period, geo_key AS geography, " + ", ".join(tables.ALIASES) + " FROM wide")
def obs_wide_pivot(spark, sf):
    return _wide(spark, sf)


@query(OBS + " SELECT geography, period, series_id, value FROM obs WHERE upper(geography) IN ('FRANCE', 'NATION_1', 'NATION_2', 'GERMANY') AND period >= '1995' AND period <= '1996-06'")
def filter_geographies_periods(spark, sf):
    d = dataset.Dataset(tables.observations(spark, sf), tables.variables(spark), tuple(tables.ALIASES))
    out = d.filter_geographies(["france", "NATION_1", "NATION_2", "GERMANY"]).filter_periods("1995", "1996-06")
    return out.observations.select("geography", "period", "series_id", "value")


@query(OBS + " SELECT geography, period, CASE WHEN series_id = 'BUILDING' THEN 'homes' ELSE 'orders:' || series_id END AS indicator, value FROM obs")
def select_and_rename(spark, sf):
    d = dataset.Dataset(tables.observations(spark, sf), tables.variables(spark), tuple(tables.ALIASES)).select_variables(["building"]).rename_variable("building", "homes")
    return d.long().select("geography", "period", "indicator", "value")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') AS annual, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS quarterly,
  strftime(o_orderdate, '%Y-%m') AS monthly, 'monthly' AS inferred, year(o_orderdate)::INT * 12 + month(o_orderdate)::INT - 1 AS slot, strftime(o_orderdate, '%Y-%m') || '-01' AS first_day FROM orders""")
def period_canonical(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    as_ = lambda f: periods.canonical_period(day, F.lit(f))
    month = as_("monthly")
    return tables.read(spark, sf, "orders").select("o_orderkey", as_("annual").alias("annual"), as_("quarterly").alias("quarterly"), month.alias("monthly"), periods.infer_frequency(month).alias("inferred"), periods.period_slot(month).alias("slot"), periods.period_to_iso_date(month).alias("first_day"))


STATS = """count(v)::BIGINT AS count, (count(*) - count(v))::BIGINT AS missing, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.1), 4) AS p10,
  round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr, round(stddev_samp(v), 3) AS std, round(CASE WHEN min(v) >= 0 AND avg(v) <> 0 THEN stddev_samp(v) / abs(avg(v)) END, 6) AS cv"""


@query(WIDE + f" SELECT alias, {STATS}, min(period) FILTER (WHERE v IS NOT NULL) AS first_period, max(period) FILTER (WHERE v IS NOT NULL) AS last_period, count(v)::BIGINT AS periods_available FROM (SELECT *, value AS v FROM cells) GROUP BY alias")
def describe_by_segment(spark, sf):
    d = describe.describe_wide(_wide(spark, sf), tables.ALIASES)
    return d.select("alias", "count", "missing", _r("mean"), "min", "max", *map(_r, ("p10", "p25", "p50", "p75", "p90", "iqr")), _r("std", 3), _r("cv", 6), "first_period", "last_period", "periods_available")


@query("SELECT l_returnflag, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis, round(skewness(l_extendedprice), 6) AS price_skewness FROM lineitem GROUP BY l_returnflag")
def skew_kurt(spark, sf):
    pick = lambda c, name: next(x for x in describe.statistics(F.col(c)) if name in str(x).split(" AS ")[-1])
    return tables.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(pick("l_quantity", "skewness"), 6).alias("skewness"), F.round(pick("l_quantity", "kurtosis"), 6).alias("kurtosis"), F.round(pick("l_extendedprice", "skewness"), 6).alias("price_skewness"))


_PAIRS = [(a, b) for i, a in enumerate(tables.ALIASES) for b in tables.ALIASES[i + 1 :]]


def _matrix(cells: str, tail: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {cells.format(a=a, b=b)} FROM {{t}}".replace("{t}", tail.format(a=a, b=b)) for a, b in _PAIRS for x, y in ((a, b), (b, a)))


_ONES = " UNION ALL ".join(f"SELECT '{a}' AS x, '{a}' AS y, 1.0::DOUBLE AS r, NULL::BIGINT AS n" for a in tables.ALIASES)


@query(WIDE + " " + _matrix("round(corr({a}, {b}), 6) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)::BIGINT AS n", "wide") + " UNION ALL " + _ONES)
def pearson_matrix(spark, sf):
    return describe.correlation_matrix(_wide(spark, sf), tables.ALIASES).withColumn("r", F.round("r", 6))


_RANKED = "(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(WIDE + " " + _matrix("round(corr(ra, rb), 6) AS r, count(*)::BIGINT AS n", _RANKED) + " UNION ALL " + _ONES)
def spearman_matrix(spark, sf):
    return describe.correlation_matrix(_wide(spark, sf), tables.ALIASES, "spearman").withColumn("r", F.round("r", 6))


_COV = "count(*)::BIGINT AS total, (count(*) - count(value))::BIGINT AS missing, round_even(100.0::DOUBLE * (count(*) - count(value)) / count(*), 2) AS missing_pct, round_even(100.0::DOUBLE - round_even(100.0::DOUBLE * (count(*) - count(value)) / count(*), 2), 2) AS coverage_pct"


@query(WIDE + f" SELECT alias, {_COV} FROM cells GROUP BY alias")
def missing_by_variable(spark, sf):
    return missing.by(_cells(spark, sf), "alias")


@query(WIDE + f" SELECT geo_key, {_COV} FROM cells GROUP BY geo_key")
def missing_by_geo(spark, sf):
    return missing.by(_cells(spark, sf), "geo_key")


@query(WIDE + " SELECT alias, period, round_even(100.0::DOUBLE * count(value) / count(*), 1) AS coverage_pct FROM cells GROUP BY alias, period")
def coverage_matrix(spark, sf):
    return missing.coverage_matrix(_cells(spark, sf))


@query(WIDE + " SELECT alias, geo_key, bool_and(value IS NULL) AS all_missing FROM cells GROUP BY alias, geo_key")
def missingness_matrix(spark, sf):
    return missing.absent_matrix(_cells(spark, sf))


@query(WIDE + """, p AS (SELECT period, row_number() OVER (ORDER BY period) AS pos FROM (SELECT DISTINCT period FROM wide)),
 h AS (SELECT alias, geo_key, pos, lead(pos) OVER (PARTITION BY alias, geo_key ORDER BY pos) - pos - 1 AS gap FROM cells JOIN p USING (period) WHERE value IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY gap DESC, geo_key, pos) AS n FROM h WHERE gap > 0)
 SELECT alias, gap::BIGINT AS longest_gap, geo_key, a.period AS gap_start, z.period AS gap_end FROM r JOIN p a ON a.pos = r.pos + 1 JOIN p z ON z.pos = r.pos + r.gap WHERE n = 1""")
def longest_gap(spark, sf):
    return missing.longest_gap(_cells(spark, sf))


_SLOT = "(left(period, 4)::INT * 12 + right(period, 2)::INT - 1)"


@query(OBS + f" SELECT provider, series_id, geography AS geo_key, (max({_SLOT}) - min({_SLOT}) + 1)::BIGINT AS expected, count(*)::BIGINT AS rows, (max({_SLOT}) - min({_SLOT}) + 1 - count(*))::BIGINT AS gaps FROM obs GROUP BY ALL HAVING count(*) >= 3 AND max({_SLOT}) - min({_SLOT}) + 1 > count(*)")
def time_gap(spark, sf):
    return validate.time_gaps(tables.observations(spark, sf))


@query(WIDE + """ SELECT geo_key, period, alias, value, last_value(value IGNORE NULLS) OVER w AS filled, value IS NULL AND last_value(value IGNORE NULLS) OVER w IS NOT NULL AS was_filled
 FROM cells WINDOW w AS (PARTITION BY geo_key, alias ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward_marked(spark, sf):
    return missing.fill_marked(_cells(spark, sf), ["geo_key", "alias"], [F.col("period")])


@query(WIDE + """ SELECT geo_key, period, alias, value, first_value(value IGNORE NULLS) OVER w AS filled, value IS NULL AND first_value(value IGNORE NULLS) OVER w IS NOT NULL AS was_filled
 FROM cells WINDOW w AS (PARTITION BY geo_key, alias ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill_backward_marked(spark, sf):
    return missing.fill_marked(_cells(spark, sf), ["geo_key", "alias"], [F.col("period")], direction="backward")


@query(OBS + f""", s AS (SELECT series_id, geography, {_SLOT} AS slot, value FROM obs), g AS (SELECT *, slot - row_number() OVER (PARTITION BY series_id, geography ORDER BY slot) AS run FROM s)
 SELECT series_id, geography, run::BIGINT AS run, min(slot)::INT AS start, max(slot)::INT AS "end", count(*)::BIGINT AS points FROM g GROUP BY ALL""")
def unbroken_runs(spark, sf):
    rows = tables.observations(spark, sf).withColumn("slot", periods.period_slot(F.col("period")))
    return missing.runs(rows, ["series_id", "geography"], "slot").withColumn("run", F.col("run").cast("long"))


@query("SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    rows = tables.read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("provider"), F.col("l_suppkey").cast("string").alias("series_id"), F.lit(None).cast("string").alias("iso3"), F.col("l_returnflag").alias("geography"), F.col("l_linestatus").alias("period"))
    return validate.duplicate_keys(rows).select(F.col("provider").cast("long").alias("l_partkey"), F.col("series_id").cast("long").alias("l_suppkey"), F.col("geo_key").alias("l_returnflag"), F.col("period").alias("l_linestatus"), "n")


@query("SELECT o_orderpriority AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def status_counts(spark, sf):
    return validate.status_counts(tables.read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "status"))


@query(WIDE + """, m AS (SELECT *, median(value) OVER (PARTITION BY alias, geo_key) AS med, count(value) OVER (PARTITION BY alias, geo_key) AS n FROM cells WHERE value IS NOT NULL),
 d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY alias, geo_key) AS mad, avg(abs(value - med)) OVER (PARTITION BY alias, geo_key) AS mean FROM m),
 s AS (SELECT *, CASE WHEN n < 5 THEN NULL WHEN mad > 0 THEN 0.6745 * (value - med) / mad ELSE (value - med) / nullif(1.253314 * mean, 0) END AS score FROM d)
 SELECT alias, geo_key, period, round(score, 6) AS score FROM s WHERE abs(score) >= 3.5""")
def mad_outliers(spark, sf):
    return outliers.modified_z(_cells(spark, sf), ["alias", "geo_key"]).select("alias", "geo_key", "period", _r("score", 6))


@query(WIDE + """, m AS (SELECT alias, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM cells GROUP BY alias)
 SELECT alias, geo_key, period, value, round_even((value - mean) / sd, 3) AS score FROM cells JOIN m USING (alias) WHERE n >= 3 AND sd > 0 AND abs((value - mean) / sd) >= 3""")
def z_outliers(spark, sf):
    return outliers.z_scores(_cells(spark, sf), ["alias"]).select("alias", "geo_key", "period", "value", "score")


@query(WIDE + """, m AS (SELECT alias, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM cells GROUP BY alias)
 SELECT alias, geo_key, period, value, round_even(CASE WHEN value < q1 THEN q1 - value ELSE value - q3 END / (q3 - q1), 3) AS distance FROM cells JOIN m USING (alias)
 WHERE n >= 4 AND q3 <> q1 AND (value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1))""")
def iqr_outliers(spark, sf):
    return outliers.iqr_fences(_cells(spark, sf), ["alias"], multiplier=3.0).select("alias", "geo_key", "period", "value", "distance")


_MONTH = OBS + ", t AS (SELECT series_id, period, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM obs GROUP BY ALL)"


def _months(spark, sf):
    return tables.observations(spark, sf).groupBy("series_id", "period").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


@query(_MONTH + """, l AS (SELECT *, lag(value, 12) OVER (PARTITION BY series_id ORDER BY period) AS base FROM t) SELECT series_id, period, round_even((value - base) / base * 100, 2) AS yoy FROM l WHERE base <> 0""")
def yoy_change(spark, sf):
    return derive.year_over_year(_months(spark, sf), ["series_id"], "monthly")


@query(_MONTH + f", s AS (SELECT *, {_SLOT} AS slot FROM t) SELECT a.series_id, a.period, round_even((a.value - b.value) / b.value * 100, 2) AS yoy FROM s a JOIN s b ON a.series_id = b.series_id AND a.slot = b.slot + 12 WHERE b.value <> 0")
def yoy_change_calendar(spark, sf):
    return derive.year_over_year_calendar(_months(spark, sf), ["series_id"], periods.period_slot(F.col("period")), 12).select("series_id", "period", "yoy")


_TRADE = """WITH t AS (SELECT s_nationkey AS nation, year(l_shipdate)::INT AS year, 'export' AS flow, l_extendedprice::DECIMAL(18,2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 UNION ALL SELECT c_nationkey, year(l_shipdate)::INT, 'import', l_extendedprice::DECIMAL(18,2) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(_TRADE + """ SELECT nation, year, coalesce(sum(value) FILTER (WHERE flow = 'export'), 0)::DOUBLE AS exports, coalesce(sum(value) FILTER (WHERE flow = 'import'), 0)::DOUBLE AS imports,
 (coalesce(sum(value) FILTER (WHERE flow = 'export'), 0) - coalesce(sum(value) FILTER (WHERE flow = 'import'), 0))::DOUBLE AS balance FROM t GROUP BY nation, year""")
def trade_balance(spark, sf):
    out = derive.trade_balance(tables.trade(spark, sf), ["nation", "year"])
    return out.select("nation", "year", *(F.col(c).cast("double").alias(c) for c in ("exports", "imports", "balance")))


@query("SELECT n_regionkey AS region, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*)::BIGINT AS members FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def member_sum(spark, sf):
    o, c, n = (tables.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("region"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    return derive.member_sum(rows, ["region", "period"]).withColumn("total", F.col("total").cast("double"))


@query("SELECT l_suppkey, l_shipdate::DATE AS date, max(l_extendedprice) AS value, count(*)::BIGINT AS segments FROM lineitem GROUP BY ALL")
def segment_merge(spark, sf):
    rows = tables.read(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"))
    return derive.merge_segments(rows, ["l_suppkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_wins(spark, sf):
    return derive.first_of(tables.read(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, arg_max_null(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_wins(spark, sf):
    return derive.last_by_date(tables.read(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def strongest_record(spark, sf):
    return derive.strongest_record(tables.read(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_totalprice", ["o_orderkey"])


@query("SELECT o_custkey, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::INT] AS value FROM orders GROUP BY o_custkey")
def duplicate_date_collapse(spark, sf):
    return derive.collapse_dates(tables.read(spark, sf, "orders").withColumnRenamed("o_totalprice", "value"), ["o_custkey"])


@query(OBS + """, p AS (SELECT series_id, geography, period, value, row_number() OVER (PARTITION BY series_id, geography ORDER BY period LIKE '1996%' DESC, period DESC) AS n FROM obs),
 r AS (SELECT *, row_number() OVER (ORDER BY value DESC, series_id, geography) AS rank FROM p WHERE n = 1) SELECT rank::INT AS rank, series_id, geography, period AS date, value FROM r WHERE rank <= 10""")
def top_n_latest(spark, sf):
    return derive.top_n(tables.observations(spark, sf), ["series_id", "geography"], 10, year=1996)


@query(OBS + " SELECT series_id, geography, max(period) AS latest_date, arg_max(value, period) AS latest_value FROM obs GROUP BY ALL")
def latest_per_series(spark, sf):
    return derive.latest(tables.observations(spark, sf), ["series_id", "geography"])


@query(OBS + " SELECT series_id, geography, period, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, geography ORDER BY period DESC) AS n FROM obs) WHERE n <= 3")
def tail_periods(spark, sf):
    return derive.tail(tables.observations(spark, sf), ["series_id", "geography"], 3).select("series_id", "geography", "period", "value")


_VERSIONS = OBS + """, a AS (SELECT * FROM obs WHERE obs_seq % 7 <> 0), b AS (SELECT * REPLACE (CASE WHEN obs_seq % 5 = 0 THEN value + 1 ELSE value END AS value) FROM obs WHERE obs_seq % 11 <> 0),
 j AS (SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.geography, b.geography) AS geo_key, coalesce(a.period, b.period) AS period, a.value AS old, b.value AS new,
  CASE WHEN a.provider IS NULL THEN 'new' WHEN b.provider IS NULL THEN 'removed' WHEN abs(a.value - b.value) > 1e-9 THEN 'updated' END AS change
  FROM a FULL JOIN b ON a.series_id = b.series_id AND a.geography = b.geography AND a.period = b.period)"""


def _two_versions(spark, sf):
    obs = tables.observations(spark, sf)
    return obs.filter("obs_seq % 7 <> 0"), obs.filter("obs_seq % 11 <> 0").withColumn("value", F.when(F.col("obs_seq") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))


@query(_VERSIONS + " SELECT count(*) FILTER (WHERE change = 'new')::BIGINT AS new_observations, count(*) FILTER (WHERE change = 'updated')::BIGINT AS updated_observations, count(*) FILTER (WHERE change = 'removed')::BIGINT AS removed_observations FROM j")
def version_diff_counts(spark, sf):
    return diff.change_counts(*_two_versions(spark, sf))


@query(_VERSIONS + " SELECT 'orders' AS provider, series_id, geo_key, period, old, new, change FROM j WHERE change IS NOT NULL")
def version_diff_rows(spark, sf):
    return diff.changes(*_two_versions(spark, sf))


@query(_VERSIONS + " SELECT 'orders' AS provider, series_id, geo_key, period, old, new, change FROM j WHERE change IS NOT NULL")
def version_diff_stored(spark, sf):
    """The same from two stored versions, by the ranges whose digests differ."""
    path = landing.folder(spark, "versions")
    for n, rows in enumerate(_two_versions(spark, sf)):
        versions.write_version(rows, path, n, n - 1 if n else None)
    return versions.changes(spark, path, 0, 1)


@query(OBS + " SELECT series_id, geography, period, value, CASE WHEN series_id = 'BUILDING' AND period LIKE '1996-0%' THEN 1 ELSE 0 END AS changed FROM obs")
def version_held(spark, sf):
    """A version of which a few months differ, read back from what both versions hold."""
    path, rows = landing.folder(spark, "versions"), tables.observations(spark, sf).withColumn("changed", F.lit(0))
    later = F.when((F.col("series_id") == "BUILDING") & F.col("period").startswith("1996-0"), 1).otherwise(0)
    versions.write_version(rows, path, 0)
    versions.write_version(rows.withColumn("changed", later), path, 1, 0)
    return versions.read_version(spark, path, 1).select("series_id", "geography", "period", "value", "changed")


@query("""WITH f AS (SELECT n.n_name, max(CASE WHEN c.c_nationkey IS NOT NULL THEN 1 END) AS hit FROM nation n LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9990) c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name)
 SELECT count(*)::BIGINT AS requested, count(hit)::BIGINT AS covered, count(hit)::DOUBLE / count(*) AS ratio, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE hit IS NULL), '') AS missing FROM f""")
def geo_coverage(spark, sf):
    n, c = tables.read(spark, sf, "nation"), tables.read(spark, sf, "customer").filter("c_acctbal > 9990")
    return geography.coverage(n, n.join(c, n.n_nationkey == c.c_nationkey), "n_name")


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990)")
def missing_geographies(spark, sf):
    n, c = tables.read(spark, sf, "nation"), tables.read(spark, sf, "customer").filter("c_acctbal > 9990")
    return geography.missing(n, n.join(c, n.n_nationkey == c.c_nationkey), "n_name")


@query("SELECT r_name, n_name AS member FROM region JOIN nation ON n_regionkey = r_regionkey")
def region_expand(spark, sf):
    r, n = tables.read(spark, sf, "region"), tables.read(spark, sf, "nation")
    lists = n.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("members"))
    return geography.expand(r.join(lists, r.r_regionkey == lists.n_regionkey).select("r_name", "members"))


_STOP = ", ".join(f"'{w}'" for w in text.ENGLISH_STOP)
_TOK = "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda x: len(x) >= 2 AND x NOT IN (" + _STOP + "))"


_COS = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) AS score FROM embeddings)"""


def _first_vector(spark, sf):
    return tables.read(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(_COS + " SELECT vec_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf):
    return search.vector_top(tables.read(spark, sf, "embeddings"), _first_vector(spark, sf), 20).select("vec_id", _r("score", 6))


@query(_COS + """, a AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM s WHERE score > 0 ORDER BY r LIMIT 20),
 b AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings ORDER BY r LIMIT 20)
 SELECT vec_id, round(sum(1.0 / (60 + r))::DOUBLE, 10) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id""")
def rrf_fusion(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    near = search.vector_top(v, _first_vector(spark, sf), 20)
    return search.reciprocal_rank_fusion([near, v.select("vec_id", F.col("label").alias("score"))], "vec_id").select("vec_id", _r("rrf", 10))


@query(_COS + """, a AS (SELECT vec_id, score FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS r FROM embeddings WHERE label >= 3)
 SELECT vec_id, round(CASE WHEN score IS NULL THEN 0.55 - least(0.1, 0.005 * r) ELSE score + coalesce(0.02 / (r + 1), 0) END::DOUBLE, 6) AS fused FROM a FULL JOIN b USING (vec_id)""")
def legacy_fusion(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    near = search.vector_top(v, _first_vector(spark, sf), 20)
    return search.legacy_fusion(near, v.filter("label >= 3").select("vec_id", F.col("label").alias("score")), "vec_id", cut=1_000_000).select("vec_id", _r("fused", 6))


@query(_COS + ", t AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS n FROM s WHERE score > 0) SELECT round(max(score) FILTER (WHERE n = 1), 6) AS first, round(max(score) FILTER (WHERE n = 3), 6) AS third, max(score) FILTER (WHERE n = 1) - max(score) FILTER (WHERE n = 3) < 0.05 * max(score) FILTER (WHERE n = 1) AS ambiguous FROM t")
def ambiguity_gate(spark, sf):
    near = search.vector_top(tables.read(spark, sf, "embeddings"), _first_vector(spark, sf), 20)
    return search.ambiguity(near, "score").select(_r("first", 6), _r("third", 6), "ambiguous")


@query("""WITH r AS (SELECT source, quality, 1 + source.length()::DOUBLE AS w FROM labels JOIN documents USING (doc_id)),
 s AS (SELECT source, sum(w) AS sw, sum(w) * sum(w) / sum(w * w) AS n, sum(w * quality) / sum(w) AS p FROM r GROUP BY source),
 l AS (SELECT *, greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) AS low FROM s)
 SELECT count(*)::BIGINT AS strata, round(sum(n), 6) AS effective_n, round(greatest(0, least(1, sum(sw * low) / sum(sw))), 6) AS lower_bound FROM l""")
def kish_wilson(spark, sf):
    rows = tables.read(spark, sf, "labels").join(tables.read(spark, sf, "documents"), "doc_id").withColumn("w", 1.0 + F.length("source"))
    return survey_stats.stratified_bound(rows, "source", "w", "quality").select("strata", _r("effective_n", 6), _r("lower_bound", 6))


@query("""WITH h AS (SELECT doc_id, ('0x' || substr(sha256('split|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS r FROM documents)
 SELECT doc_id, CASE WHEN r < 0.8::DOUBLE THEN 'train' WHEN r < 0.9::DOUBLE THEN 'dev' ELSE 'test' END AS part FROM h""")
def hash_split(spark, sf):
    ratio = survey_stats.hash_ratio(F.lit("split"), F.col("doc_id").cast("string"))
    return tables.read(spark, sf, "documents").select("doc_id", survey_stats.split(ratio, {"train": 0.8, "dev": 0.1, "test": 0.1}).alias("part"))


@query("""SELECT ts::DATE AS day, count(*)::BIGINT AS events, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors, count(DISTINCT user_id)::BIGINT AS users,
 sum(value::DECIMAL(18,4)) FILTER (WHERE event_type = 'purchase')::DOUBLE AS purchases FROM events GROUP BY 1""")
def daily_stats(spark, sf):
    e = tables.read(spark, sf, "events")
    return derive.daily(e, "ts", F.col("event_type") == "error", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM events")
def rate_window(spark, sf):
    e = tables.read(spark, sf, "events").withColumn("s", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    return derive.rolling_count(e, ["user_id"], F.col("s"), 3600).select("event_id", "in_window")


@query("""WITH l AS (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS step FROM events), g AS (SELECT user_id, list_sort(list(step)) AS s FROM l WHERE step > 0 GROUP BY user_id),
 m AS (SELECT user_id, s[(len(s) // 2 + 1)::INT] AS median_us FROM g) SELECT user_id, median_us::BIGINT AS median_us, CASE WHEN median_us <= 1800000000 THEN 'minutely' WHEN median_us <= 21600000000 THEN 'hourly' ELSE 'daily' END AS frequency FROM m""")
def spacing_frequency(spark, sf):
    return derive.spacing_frequency(tables.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts")


@query("""WITH s AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages),
 d AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM s)
 SELECT page_id, trim(regexp_replace(t, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS text FROM d""")
def strip_markup(spark, sf):
    return tables.read(spark, sf, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS day, date_part('year', o_orderdate)::INT AS year FROM orders WHERE date_part('year', o_orderdate) BETWEEN 1994 AND 1996 OR o_orderkey % 50 = 0")
def time_window_filter(spark, sf):
    o = tables.read(spark, sf, "orders").withColumn("label", F.when(F.col("o_orderkey") % 50 == 0, "undated").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return derive.in_years(o, "label", 1994, 1996).select("o_orderkey", F.trunc("o_orderdate", "month").alias("day"), F.year("o_orderdate").alias("year"))


@query("SELECT p_brand, coalesce(nullif(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END, ''), 'unknown') AS p_type, count(*)::BIGINT AS series FROM part GROUP BY ALL")
def catalogue_by_provider_topic(spark, sf):
    p = tables.read(spark, sf, "part").withColumn("p_type", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_type")))
    return search.catalogue_counts(p, ("p_brand", "Uncategorised"), ("p_type", "unknown"))


@query("SELECT p_brand AS topic, count(*)::BIGINT AS series FROM part GROUP BY 1")
def catalogue_counts(spark, sf):
    return search.catalogue_counts(tables.read(spark, sf, "part").withColumnRenamed("p_brand", "topic"), ("topic", "Uncategorised"))


@query("SELECT provider, code, name FROM (SELECT p_brand AS provider, p_type AS code, p_name AS name, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def catalogue_build(spark, sf):
    p = tables.read(spark, sf, "part").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("code"), F.col("p_name").alias("name"), "p_partkey")
    return search.build_catalogue(p, "p_partkey").select("provider", "code", "name")


@query("SELECT provider, code, name FROM (SELECT p_brand AS provider, p_type AS code, p_name AS name, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1")
def catalogue_upsert(spark, sf):
    p = tables.read(spark, sf, "part").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("code"), F.col("p_name").alias("name"), "p_partkey")
    return search.build_catalogue(p, "p_partkey", upsert=True).select("provider", "code", "name")


@query("SELECT l_orderkey, l_linenumber, (l_orderkey % 24)::BIGINT AS idx, [((l_orderkey % 24) // 12)::BIGINT, (((l_orderkey % 24) // 4) % 3)::BIGINT, ((l_orderkey % 24) % 4)::BIGINT] AS coords, (l_orderkey % 24)::BIGINT AS again FROM lineitem")
def cube_coordinates(spark, sf):
    rows = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 24).alias("idx"))
    sizes = F.array(F.lit(2).cast("long"), F.lit(3).cast("long"), F.lit(4).cast("long"))
    rows = rows.withColumn("coords", cube.coordinates(F.col("idx"), sizes))
    return rows.withColumn("again", cube.flat_index(sizes, F.col("coords")))


@query("SELECT count(*)::BIGINT AS rows, 0::BIGINT AS missing_cells, (count(*) - count(DISTINCT (c_nationkey, c_mktsegment)))::BIGINT AS duplicate_rows FROM customer")
def table_profile(spark, sf):
    return describe.table_profile(tables.read(spark, sf, "customer").select("c_nationkey", "c_mktsegment"))


@query("""SELECT 'p_size' AS variable, 'numeric' AS kind, count(DISTINCT p_size)::BIGINT AS distinct, 0::BIGINT AS missing, round(avg(p_size), 4) AS mean, round(stddev_samp(p_size), 4) AS std, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, 0::BIGINT AS zeros, 0::BIGINT AS negatives FROM part
 UNION ALL SELECT 'p_brand', 'text', count(DISTINCT p_brand), 0, NULL, NULL, NULL, NULL, 0, 0 FROM part UNION ALL SELECT 'p_retailprice', 'numeric', count(DISTINCT p_retailprice), 0, round(avg(p_retailprice), 4), round(stddev_samp(p_retailprice), 4), min(p_retailprice), max(p_retailprice), 0, 0 FROM part""".replace("AS distinct", 'AS "distinct"'))
def column_profile(spark, sf):
    return describe.profile(tables.read(spark, sf, "part"), ["p_size", "p_retailprice", "p_brand"]).select("variable", "kind", "distinct", "missing", _r("mean"), _r("std"), "min", "max", "zeros", "negatives")


@query(OBS + """ SELECT provider, series_id, count(DISTINCT geography)::BIGINT AS geographies, count(DISTINCT period)::BIGINT AS periods, count(*)::BIGINT AS cells, 0::BIGINT AS duplicates,
 (count(DISTINCT geography) * count(DISTINCT period))::BIGINT AS expected, count(*) = count(DISTINCT geography) * count(DISTINCT period) AS balanced FROM obs GROUP BY provider, series_id""")
def panel_balance(spark, sf):
    return describe.panel_balance(tables.observations(spark, sf), dataset.geo_key())


FR_LIST, EN_LIST = (str(list(x)).replace('"', "'") for x in (text.FRENCH_MARKS, text.ENGLISH_MARKS))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN left(text, 40) || ' سعر' ELSE text END AS text FROM documents),
 w AS (SELECT *, list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z]+')) AS ws FROM d)
 SELECT doc_id, CASE WHEN text IS NULL THEN 'en' WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'ar'
  WHEN len(list_intersect(ws, {FR_LIST})) + CASE WHEN text <> strip_accents(text) THEN 2 ELSE 0 END > len(list_intersect(ws, {EN_LIST})) THEN 'fr' ELSE 'en' END AS script FROM w""")
def script_of_documents(spark, sf):
    shown = F.when(F.col("doc_id") % 10 == 0, F.concat(F.left("text", F.lit(40)), F.lit(" سعر"))).otherwise(F.col("text"))
    return tables.read(spark, sf, "documents").select("doc_id", text.detect_language(shown).alias("script"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*)::BIGINT AS events FROM events GROUP BY ALL")
def event_tumbling(spark, sf):
    out = streams.tumbling(tables.read(spark, sf, "events"), ["event_type"], "1 hour")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "events")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*)::BIGINT AS events FROM s GROUP BY user_id, n""")
def event_session(spark, sf):
    out = streams.sessions(tables.read(spark, sf, "events"), ["user_id"], "30 minutes")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "events")


@query("""WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])::TIMESTAMP AS start FROM events) SELECT event_type, start, count(*)::BIGINT AS events FROM s GROUP BY ALL""")
def event_sliding(spark, sf):
    out = streams.sliding(tables.read(spark, sf, "events"), ["event_type"], "1 hour", "30 minutes")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "events")


@query(OBS + """, d AS (SELECT series_id, geography, count(*) AS c FROM obs GROUP BY ALL) SELECT 'time_gap' AS code, 'warning' AS severity, count(*)::BIGINT AS issues FROM (
 SELECT 1 FROM obs GROUP BY series_id, geography HAVING count(*) >= 3 AND max(left(period, 4)::INT * 12 + right(period, 2)::INT) - min(left(period, 4)::INT * 12 + right(period, 2)::INT) + 1 > count(*))""")
def validation_time_gaps(spark, sf):
    issues = validate.validate(tables.observations(spark, sf), tables.variables(spark))
    return issues.filter("code = 'time_gap'").agg(F.lit("time_gap").alias("code"), F.lit("warning").alias("severity"), F.count(F.lit(1)).alias("issues"))


@query("SELECT p_partkey, p_size::DOUBLE * power(10.0, 3)  AS thousands, CASE WHEN p_retailprice > 0 THEN floor(log10(p_retailprice))::BIGINT END AS magnitude FROM part")
def scale_conversion(spark, sf):
    return tables.read(spark, sf, "part").select("p_partkey", values.rescale(F.col("p_size").cast("double"), 3, 0).alias("thousands"), values.magnitude(F.col("p_retailprice")).alias("magnitude"))


@query("SELECT o_orderkey, o_orderstatus, CASE lower(o_orderpriority[1:1]) WHEN '1' THEN 'urgent' ELSE 'other' END AS kind FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) BETWEEN 21 AND 40")
def pagination(spark, sf):
    """A page of a dataset's rows by Dataset.rows is `dataset_page`; this one pages any sorted table."""
    o = tables.read(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").offset(20).limit(20)
    return o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("other").alias("kind"))


@query(OBS + """ SELECT geography, period, lower(series_id) AS indicator, value FROM obs QUALIFY row_number() OVER (ORDER BY geography, period, lower(series_id)) BETWEEN 31 AND 70""")
def dataset_page(spark, sf):
    d = dataset.Dataset(tables.observations(spark, sf), tables.variables(spark), tuple(tables.ALIASES), "long")
    return d.rows(30, 40).select("geography", "period", "indicator", "value")


@query("""SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (WHERE role = 'user')::BIGINT AS user_turns, arg_max(role, turn) AS last_role, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def conversation_fold(spark, sf):
    return streams.fold_batch(tables.read(spark, sf, "conversations"))


_W = "regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[\\p{L}\\p{N}]+')"


@query(f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS w FROM documents), p(phrase, concept) AS (VALUES ('the', 'article'), ('of the', 'pair'), ('and the', 'pair'), ('is the of and the was that', 'long'))
 SELECT DISTINCT doc_id, concept FROM t JOIN p ON contains(w, ' ' || phrase || ' ')""")
def title_tagging(spark, sf):
    phrases = spark.createDataFrame([("the", "article"), ("of the", "pair"), ("and the", "pair"), ("is the of and the was that", "long")], "phrase string, concept string")
    return search.tag_titles(tables.catalogue(spark, sf), phrases).withColumnRenamed("id", "doc_id")


@query("SELECT provider, user_id, seconds::BIGINT AS seconds, recent::BIGINT AS recent FROM (SELECT 'p' AS provider, user_id, event_type, epoch(ts)::BIGINT AS seconds, count(*) FILTER (WHERE event_type = 'error') OVER (ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE event_type = 'error' AND recent >= 2")
def circuit_breaker(spark, sf):
    e = tables.read(spark, sf, "events").select(F.lit("p").alias("provider"), "user_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("seconds"), (F.col("event_type") != "error").alias("ok"))
    return streams.breaker(e, 2, 300).select("provider", "user_id", "seconds", "recent")


@query(OBS + """, o AS (SELECT series_id, geography, period, value FROM obs) SELECT 'v' || 1 AS name, count(*)::BIGINT AS points, count(DISTINCT series_id)::BIGINT AS series FROM o WHERE left(period, 4) = '1995'""")
def window_points(spark, sf):
    o = derive.in_years(tables.observations(spark, sf), "period", 1995, 1995)
    return o.agg(F.count(F.lit(1)).alias("points"), F.countDistinct("series_id").alias("series")).select(F.lit("v1").alias("name"), "points", "series")


@query("""SELECT period AS date, max(value) FILTER (WHERE series_id = 'BUILDING') AS "BUILDING", max(value) FILTER (WHERE series_id = 'MACHINERY') AS "MACHINERY" FROM (""" + _MONTH + """ SELECT * FROM t WHERE series_id IN ('BUILDING', 'MACHINERY')) GROUP BY period""")
def align_series(spark, sf):
    rows = _months(spark, sf).filter(F.col("series_id").isin("BUILDING", "MACHINERY")).select(F.col("period").alias("date"), F.col("series_id").alias("series"), "value", F.lit(1).alias("seq"))
    return sinks.align_series(rows, ["BUILDING", "MACHINERY"])


@query("""SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n FROM (SELECT *, bool_or(o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey) AS has FROM orders) WHERE NOT has OR o_orderpriority = '1-URGENT' GROUP BY ALL""")
def total_commodity_filter(spark, sf):
    rows = tables.read(spark, sf, "orders").withColumn("code", F.when(F.col("o_orderpriority") == "1-URGENT", "TOTAL").otherwise("x"))
    return derive.total_filter(rows, ["o_custkey"], "code").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1994-03-01' AND DATE '1995-12-31'")
def date_range_filter(spark, sf):
    return tables.read(spark, sf, "orders").filter(periods.within_dates(F.col("o_orderdate"), (1994, 3, None), (1995, None, None))).select("o_orderkey")


@query(OBS + """ SELECT lower(series_id) AS alias, 'level' AS role, count(DISTINCT geography)::BIGINT AS geographies, count(DISTINCT period)::BIGINT AS periods, count(*)::BIGINT AS cells, count(value)::BIGINT AS present,
 'current us$' AS units, 'monthly' AS frequencies, count(*) = count(DISTINCT geography) * count(DISTINCT period) AS balanced,
 round_even(100.0::DOUBLE * count(value) / (count(DISTINCT geography) * count(DISTINCT period)), 2) AS coverage_pct FROM obs GROUP BY series_id""")
def economic_summary(spark, sf):
    return describe.economic_summary(tables.observations(spark, sf), tables.variables(spark))


@query("SELECT max(strftime(o_orderdate, '%Y-%m-%d')) AS latest, count(*) FILTER (WHERE year(o_orderdate) = 2030)::BIGINT AS in_window FROM orders")
def latest_available_date(spark, sf):
    o = tables.read(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return derive.latest_date(o, "day", 2030, 2030)


@query("""SELECT c_custkey, count(o_orderkey)::BIGINT AS orders, max(o_orderdate)::DATE AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def activity_view(spark, sf):
    out = derive.activity(tables.read(spark, sf, "customer"), tables.read(spark, sf, "orders"), "c_custkey", "o_custkey", "o_orderkey", "o_orderdate")
    return out.select("c_custkey", F.col("actions").alias("orders"), F.col("last_action").alias("last_order"))


@query("SELECT DISTINCT year(l_shipdate)::INT AS year FROM lineitem UNION SELECT DISTINCT year(o_orderdate)::INT FROM orders")
def union_of_dates(spark, sf):
    return dataset.union_dates(tables.read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")), tables.read(spark, sf, "orders").select(F.year("o_orderdate").alias("year")))


@query("""SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.n, 0)::BIGINT AS suppliers, coalesce(b.n, 0)::BIGINT AS customers FROM (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1) a
 FULL JOIN (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) b ON a.nation = b.nation""")
def full_outer_zero_fill(spark, sf):
    side = lambda t, c, flow: tables.read(spark, sf, t).select(F.col(c).alias("nation"), F.lit(flow).alias("flow"), F.lit(1).cast("long").alias("value"))
    out = derive.trade_balance(side("supplier", "s_nationkey", "export").unionByName(side("customer", "c_nationkey", "import")), ["nation"])
    return out.select("nation", F.col("exports").alias("suppliers"), F.col("imports").alias("customers"))


@query("""WITH s AS (SELECT c_nationkey AS nation, c_acctbal::DECIMAL(14,2) AS x, c_custkey::DECIMAL(14,2) AS y FROM customer)
 SELECT nation, (sum((x * y)::DECIMAL(28,4))::DOUBLE - sum(x)::DOUBLE * sum(y)::DOUBLE / count(*)) / nullif(count(*) - 1, 0)::DOUBLE AS covariance FROM s GROUP BY nation""")
def covariance_by_nation(spark, sf):
    c = tables.read(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(describe.covariance_exact(F.col("c_acctbal"), F.col("c_custkey")).alias("covariance"))


@query("SELECT l_returnflag, round(covar_samp(l_quantity, l_linenumber), 6) AS covariance FROM lineitem GROUP BY 1")
def covariance_by_flag(spark, sf):
    return tables.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(describe.covariance(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")), 6).alias("covariance"))


@query("""SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN page_id % 3 = 0 THEN 'http://h/p?api_key=***&q=1#top' WHEN page_id % 3 = 1 THEN 'http://h/p?q=1&Token=***' ELSE url END AS url FROM pages""")
def secret_redaction(spark, sf):
    key = F.concat(F.lit("k"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://h/p?api_key="), key, F.lit("&q=1#top"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://h/p?q=1&Token="), key)).otherwise(F.col("url"))
    return tables.read(spark, sf, "pages").select("page_id", text.redact_query_secrets(F.when(F.col("url").isNotNull(), url)).alias("url"))


@query("SELECT doc_id, len(" + _TOK.format(c="text") + ")::INT AS tokens, (" + _TOK.format(c="text") + ")[1] AS first_token FROM documents")
def token_counts(spark, sf):
    t = text.tokens(F.col("text"))
    return tables.read(spark, sf, "documents").select("doc_id", F.size(t).alias("tokens"), F.get(t, F.lit(0)).alias("first_token"))


@query("SELECT p_partkey, CASE WHEN len(w) > 4 AND w LIKE '%aux' THEN w[1:-4] || 'al' WHEN len(w) > 4 AND regexp_matches(w, '[sx]$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[1:-2] ELSE w END AS singular FROM (SELECT p_partkey, lower(p_type) AS w FROM part)")
def singular_forms(spark, sf):
    return tables.read(spark, sf, "part").select("p_partkey", text.singular(F.lower("p_type")).alias("singular"))


@query("SELECT o_orderkey, least(y, 1995)::INT AS first_year, CASE WHEN y <> 1995 THEN greatest(y, 1995)::INT END AS last_year FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def years_in_text(spark, sf):
    first, last = periods.extract_years(F.concat(F.lit("from 1995 to "), F.year("o_orderdate").cast("string")))
    return tables.read(spark, sf, "orders").select("o_orderkey", first.alias("first_year"), last.alias("last_year"))


@query("SELECT n_nationkey, unnest(range(1990 + n_nationkey, 1993 + n_nationkey))::VARCHAR AS period FROM nation")
def generated_periods(spark, sf):
    span = periods.comtrade_periods(F.col("n_nationkey") + 1990, F.col("n_nationkey") + 1992)
    return tables.read(spark, sf, "nation").select("n_nationkey", F.explode(span).alias("period"))


@query("""WITH v AS (SELECT event_id, value * 1e5 + 1 AS v FROM events) SELECT event_id, CASE WHEN abs(v) >= 1e12 THEN printf('%.1fT', v / 1e12) WHEN abs(v) >= 1e9 THEN printf('%.1fB', v / 1e9)
 WHEN abs(v) >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.1f', v) END AS shown FROM v""")
def number_scales(spark, sf):
    return tables.read(spark, sf, "events").select("event_id", values.short_number(F.col("value") * 1e5 + 1).alias("shown"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k FROM events")
def json_field(spark, sf):
    return tables.read(spark, sf, "events").select("event_id", values.json_field(F.col("props"), "$.k", "int").alias("k"))


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS rows, round(avg(CASE WHEN l_linenumber <= 3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall, round(avg(1.0::DOUBLE / l_linenumber), 6) AS mrr FROM lineitem GROUP BY ALL""")
def ranking_quality(spark, sf):
    rows = tables.read(spark, sf, "lineitem").withColumn("rank", F.col("l_linenumber"))
    out = search.ranking_quality(rows, 3, ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", F.col("queries").alias("rows"), F.round("recall_at_k", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("""SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice * 0.01 BETWEEN 0 AND 15 THEN 0.01 WHEN p_retailprice * 100 BETWEEN 0 AND 15 THEN 100.0 WHEN p_retailprice * 0.001 BETWEEN 0 AND 15 THEN 0.001 END::DOUBLE AS scale_hint FROM part WHERE NOT (p_retailprice BETWEEN 0 AND 15)""")
def range_checks(spark, sf):
    ranges = spark.createDataFrame([("rate", 0.0, 15.0)], "kind string, low double, high double")
    rows = tables.read(spark, sf, "part").withColumnRenamed("p_retailprice", "value")
    return validate.range_checks(rows, ranges, F.lit("rate")).select("p_partkey", F.col("value").alias("p_retailprice"), "scale_hint")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, count(*) FILTER (WHERE o_totalprice > 50000) AS n FROM orders GROUP BY ALL)
 SELECT o_custkey, o_orderpriority, n::BIGINT AS points, (n + 1000 * (o_orderpriority = '1-URGENT')::INT + 1000 * (o_custkey % 7 = 3)::INT)::BIGINT AS score FROM s WHERE n > 0 ORDER BY score DESC, o_custkey, o_orderpriority LIMIT 1""")
def preferred_slice(spark, sf):
    o = tables.read(spark, sf, "orders").withColumn("value", F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")))
    return derive.best_slice(o, ["o_custkey", "o_orderpriority"], [F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") % 7 == 3])


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def freshest_series(spark, sf):
    return derive.freshest(tables.read(spark, sf, "documents"), ["source"], F.col("n_chars"), ["doc_id"]).select("source", "doc_id", "n_chars")

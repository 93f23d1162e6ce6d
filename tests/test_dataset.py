import math
import time

import pytest
from pyspark.sql import functions as F

from almanack import schema
from almanack.functions import periods, text, values
from almanack.operators import dataset, derive, describe, diff, missing, outliers, survey_stats, validate
from almanack.plans import queries


def obs(spark, rows):
    full = [(p, s, g, i, t, v, u, "annual", None, n) for n, (p, s, g, i, t, v, u) in enumerate(rows)]
    return spark.createDataFrame(full, schema.OBSERVATIONS)


def variables(spark, rows):
    return spark.createDataFrame([(a, p, s, a, u, "annual", c, None, n) for n, (a, p, s, u, c) in enumerate(rows)], schema.VARIABLES)


@pytest.fixture(scope="module")
def panel(spark):
    """Two countries, six years: a gap of two years in one series, a spike in another."""
    rows = []
    for y in range(2000, 2006):
        rows += [("wb", "GDP", "Algeria", "DZA", str(y), 1800.0 + 120 * (y - 2000), "current US$"), ("wb", "GDP", "Morocco", "MAR", str(y), 1500.0 + 100 * (y - 2000), "current US$")]
        rows += [("wb", "CPI", "Morocco", "MAR", str(y), 45.0 if y == 2003 else 1.9, "%")]
        rows += [("wb", "CPI", "Algeria", "DZA", str(y), 2.5 + 0.3 * (y - 2000), "%")] if y not in (2002, 2003) else []
    return dataset.Dataset(obs(spark, rows), variables(spark, [("gdp", "wb", "GDP", "current US$", None), ("cpi", "wb", "CPI", "%", None)]), ("gdp", "cpi"))


def test_pivot_keeps_gaps(panel):
    rows = {(r.geo_key, r.period): (r.gdp, r.cpi) for r in panel.wide().collect()}
    assert len(rows) == 12
    assert rows["DZA", "2002"] == (2040.0, None) and rows["DZA", "2003"][1] is None
    assert rows["MAR", "2003"] == (1800.0, 45.0)


def test_first_value_wins_even_if_null(spark):
    o = obs(spark, [("p", "s", "X", "", "2000", None, "u"), ("p", "s", "X", None, "2000", 5.0, "u"), ("p", "s", "Y", "YYY", "2000", math.nan, "u")])
    v = variables(spark, [("a", "p", "s", "u", None), ("b", "p", "s", "u", None)])
    rows = {r.geo_key: (r.a, r.b) for r in dataset.to_wide(o, v, ["a", "b"]).collect()}
    assert rows["X"] == (None, None)  # the second variable of the series never gets it
    assert math.isnan(rows["YYY"][0])


def test_longest_gap_and_jump(panel):
    cells = missing.cells(panel.wide(), ["gdp", "cpi"])
    gap = missing.longest_gap(cells).collect()
    assert [(r.alias, r.longest_gap, r.geo_key, r.gap_start, r.gap_end) for r in gap] == [("cpi", 2, "DZA", "2002", "2003")]
    issues = validate.validate(panel.observations, panel.variables).collect()
    assert [(r.details["geography"], r.details["period"]) for r in issues if r.code == "extreme_jump"] == [("MAR", "2003")]
    assert [r.details["missing"] for r in issues if r.code == "time_gap"] == ["2"]


def test_validation_rules(spark):
    o = obs(spark, [("p", "a", "X", None, "2000", 1.0, "%"), ("p", "a", "X", None, "2000", 1.0, "%"), ("p", "a", "X", None, "2001Q1", math.inf, "people"), ("p", "b", "X", None, "2020-W05", None, None), ("p", "c", "X", None, "2001", None, None)])
    v = variables(spark, [("a", "p", "a", "%", "k"), ("b", "p", "b", None, None), ("c", "p", "c", None, None), ("d", "p", "d", None, None)])
    issues = validate.validate(o, v, "monthly", 2005)
    got = {r.code for r in issues.collect()}
    assert {"duplicate_key", "invalid_period", "non_numeric_value", "mixed_frequency", "unit_conflict", "incompatible_units_same_concept", "missing_variable", "all_values_missing", "frequency_not_available", "coverage_ends_early"} <= got
    assert validate.verdict(issues).first().status == "unusable"
    clean = obs(spark, [("p", "a", "X", None, "2000", 1.0, "%")])
    assert validate.verdict(validate.validate(clean, variables(spark, [("a", "p", "a", "%", None)]))).first().status == "clean"


def test_transformations(panel):
    one = panel.filter_geographies(["dza"]).filter_periods("2001", "2003")
    assert one.observations.count() == 4 and len(one.transformations) == 2 and panel.transformations == ()
    kept = panel.select_variables(["cpi"])
    assert {r.indicator for r in kept.long().collect()} == {"cpi", "wb:GDP"}
    assert kept.rename_variable("cpi", "prices").wide().columns == ["geo_key", "period", "geography", "prices"]
    for bad in (lambda: panel.filter_geographies([]), lambda: panel.select_variables(["x"]), lambda: panel.rename_variable("gdp", "cpi"), lambda: panel.set_shape("tall"), lambda: panel.transform("drop")):
        with pytest.raises(ValueError):
            bad()
    assert panel.preview(5)[1] and len(panel.rows(offset=10, limit=5).collect()) == 2


def test_statistics_against_formulas(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([*x, math.nan, None, math.inf])], "period string, v double")
    r = describe.describe_wide(df, ["v"]).first()
    n, m = len(x), sum(x) / len(x)
    m2, m3, m4 = (sum((v - m) ** k for v in x) / n for k in (2, 3, 4))
    assert (r["count"], r.missing) == (8, 3)
    assert r.skewness == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5)
    assert r.kurtosis == pytest.approx((n - 1) * ((n + 1) * (m4 / m2**2 - 3) + 6) / ((n - 2) * (n - 3)))
    assert r.cv == pytest.approx(r.std / m) and (r.p50, r.first_period, r.last_period) == (3.5, "0", "7")


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 1.0, 7.0), (None, 9.0, 7.0), (2.0, None, 7.0)], "a double, b double, c double")
    got = {(r.x, r.y): r.r for r in describe.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "c"] is None and got["a", "a"] == 1.0 and got["a", "b"] == pytest.approx(-0.3273268)
    rank = {(r.x, r.y): r.r for r in describe.correlation_matrix(df, ["a", "b"], "spearman").collect()}
    assert rank["a", "b"] == pytest.approx(-0.5)
    with pytest.raises(ValueError):
        describe.correlation_matrix(df, ["a"], "kendall")


def test_outliers_constant_and_small_groups(spark):
    df = spark.createDataFrame([("k", 5.0)] * 6 + [("s", 1.0), ("s", 99.0)] + [("m", 1.0)] * 6 + [("m", 50.0)], "g string, value double")
    assert [(r.g, r.value) for r in outliers.modified_z(df, ["g"]).collect()] == [("m", 50.0)]
    assert outliers.z_scores(df, ["g"]).count() == 0 and outliers.iqr_fences(df, ["g"]).count() == 0


@pytest.mark.parametrize(
    ("raw", "frequency", "label"),
    [("2020-01-01", "annual", "2020"), ("2020-05-01", "quarterly", "2020Q2"), ("2020-05-09", "monthly", "2020-05"), ("2020-05-09", "daily", "2020-05-09"), ("2020-11", "quarterly", "2020Q4"), ("2020-q3", "quarterly", "2020Q3"), ("2020Q3", "annual", "2020"), (" 2020 ", "annual", "2020"), ("2020-W05", "weekly", "2020-W05"), (None, "annual", "")],
)
def test_canonical_period(spark, raw, frequency, label):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(periods.canonical_period(F.col("p"), F.lit(frequency))).first()[0] == label


@pytest.mark.parametrize(("raw", "day", "code"), [("2020", "2020-01-01", "A"), ("2020-Q2", "2020-04-01", "Q"), ("2020Q4", "2020-10-01", "Q"), ("2020-M3", "2020-03-01", "M"), ("2020-M11", "2020-11-01", "M"), ("2020-07", "2020-07-01", "M"), ("odd", "odd", "A")])
def test_sdmx_periods(spark, raw, day, code):
    df = spark.createDataFrame([(raw,)], "p string")
    assert tuple(df.select(periods.period_to_iso_date(F.col("p")), periods.frequency_from_period(F.col("p"))).first()) == (day, code)


def test_values(spark):
    rows = spark.createDataFrame([(x,) for x in ("1.5", " . ", "NaN", "inf", "n/a", "", "-", "1e3", "x", None)], "v string")
    assert [r[0] for r in rows.select(values.sanitise(F.col("v"))).collect()] == [1.5, None, None, None, None, None, None, 1000.0, None, None]
    one = spark.range(1)
    assert one.select(values.numeric_parse(F.lit("1,234.5")), values.short_number(F.lit(2.5e6)), values.unit_family(F.lit("% of GDP index")), values.guard_formula(F.lit(" =1+1"))).first()[:] == (1234.5, "2.5M", "percent", "' =1+1")


def test_derived(spark):
    months = spark.createDataFrame([("s", f"2000-{m:02d}", float(m)) for m in range(1, 13)] + [("s", "2001-01", 2.0), ("s", "2001-02", None), ("s", "2001-03", 6.0)], "g string, period string, value double")
    assert [(r.period, r.yoy) for r in derive.year_over_year(months, ["g"], "monthly").collect()] == [("2001-01", 100.0), ("2001-03", 200.0)]
    slot = periods.period_slot(F.col("period"))
    assert {(r.period, r.yoy) for r in derive.year_over_year_calendar(months, ["g"], slot, 12).filter("yoy is not null").select("period", "yoy").collect()} == {("2001-01", 100.0), ("2001-03", 100.0)}
    flows = spark.createDataFrame([("2000", "export", 5.0), ("2001", "import", 3.0), ("2001", "import", None)], "date string, flow string, value double")
    assert {(r.date, r.balance) for r in derive.trade_balance(flows, ["date"]).collect()} == {("2000", 5.0), ("2001", -3.0)}
    members = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "d string, value double")
    assert {(r.d, r.total) for r in derive.member_sum(members, ["d"]).collect()} == {("a", 0.0), ("b", 1.0)}
    assert {(r.d, r.total) for r in derive.member_sum(members, ["d"], strict=True).collect()} == {("a", None), ("b", None)}
    ties = spark.createDataFrame([("a", "2000", 1.0), ("b", "2000", 1.0)], "k string, period string, value double")
    assert [r.k for r in derive.top_n(ties, ["k"], 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.k for r in derive.top_n(ties, ["k"], 2, ascending=True).orderBy("rank").collect()] == ["b", "a"]
    many = spark.createDataFrame([("d", v) for v in (400.0, 3.0, -60.0, 7.0)], "d string, value double")
    assert derive.collapse_dates(many, ["d"]).first().value == 7.0 and derive.collapse_dates(many, ["d"], growth=True).first().value == 7.0


def test_version_diff(spark):
    old = obs(spark, [("p", "s", "X", None, "2000", 1.0, "u"), ("p", "s", "X", None, "2001", math.nan, "u"), ("p", "s", "X", None, "2002", 3.0, "u"), ("p", "s", "X", None, "2003", None, "u")])
    new = obs(spark, [("p", "s", "X", None, "2000", 9.0, "u"), ("p", "s", "X", None, "2000", 1.5, "u"), ("p", "s", "X", None, "2001", 2.0, "u"), ("p", "s", "X", None, "2003", None, "u"), ("p", "s", "X", None, "2004", 4.0, "u")])
    got = {(r.period, r.change) for r in diff.changes(old, new).collect()}
    assert got == {("2000", "updated"), ("2002", "removed"), ("2004", "new")}
    assert diff.changes(old, old).count() == 0


def test_survey(spark):
    df = spark.createDataFrame([("a", 1.0, True)] * 9 + [("a", 1.0, False), ("b", 2.0, True), ("b", 2.0, None)], "s string, w double, ok boolean")
    r = survey_stats.stratified_bound(df, "s", "w", "ok").first()
    assert r.strata == 2 and r.effective_n == pytest.approx(11.0) and 0 < r.lower_bound < 0.9
    deal = lambda sizes, total: {r.k: r.places for r in survey_stats.allocate(spark.createDataFrame(sizes, "k string, n long"), ["k"], "n", total).collect()}
    assert deal([("a", 5), ("b", 3), ("c", 0), (None, None)], 4) == {"a": 2, "b": 2, "c": 0, None: 0}
    assert deal([("a", 1), ("b", 1), ("c", 1)], 2) == {"a": 0, "b": 1, "c": 1} and deal([("a", 2), ("b", 1)], 9) == {"a": 2, "b": 1}
    assert deal([("a", 0)], 3) == {"a": 0} and deal([("x", 6_000_000_000_000_000_000), ("y", 3)], 2_000_000_000) == {"x": 2_000_000_000, "y": 0}


def test_names(spark):
    rows = [("Inflation, consumer prices", "X", "annual %", None), ("T", "s", None, "Évolution du PIB — réel"), ("", "!!", None, None), ("Share in percent", "s", "%", None), (None, "NE.EXP.GNFS", "Index", "")]
    df = spark.createDataFrame(rows, "title string, series_id string, unit string, concept string")
    got = [r[0] for r in df.select(text.smart_alias(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["inflation_consumer_prices_pct", "evolution_du_pib_reel", "series", "share_in_percent_pct", "ne_exp_gnfs_idx"]
    names = spark.createDataFrame([(i, a) for i, a in enumerate(["a", "b", "a", "a"])], "ordinal int, alias string")
    assert [r.alias for r in dataset.alias_numbers(names).orderBy("ordinal").collect()] == ["a", "b", "a_2", "a_3"]


def test_no_gaps_are_a_count_of_nothing(spark, tmp_path):
    """SQL's aggregate without groups has a row where nothing is found."""
    spark.createDataFrame([(1, "X")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, 1, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    orders = spark.range(1, 6).selectExpr("id o_orderkey", "1L o_custkey", "'F' o_orderstatus", "10D o_totalprice", "add_months(date'2000-01-01', cast(id as int)) o_orderdate")
    for rows, issues in ((orders, 0), (orders.filter("o_orderkey <> 3"), 1)):
        rows.write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
        assert [tuple(r) for r in queries.validation_time_gaps(spark, str(tmp_path)).collect()] == [("time_gap", "warning", issues)]


def test_axes_of_a_long_array(spark):
    """Bounds are found once an array: 200,000 orders take a moment."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 11 > 0, (F.col("id") % 11 - 5).cast("int")).alias("o"))
    begin = time.monotonic()
    axes = rows.agg(F.collect_list(F.struct("o")).alias("k")).select(F.explode(F.arrays_zip(F.col("k.o").alias("o"), values.axis_buckets(F.col("k.o")).alias("a"))).alias("z")).select("z.*").distinct().collect()
    assert {r.o: r.a for r in axes} == {None: None, -4: 0, -3: 0, -2: 0, -1: 1, 0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 3} and time.monotonic() - begin < 30
    empty = spark.createDataFrame([([],), (None,), ([None],)], "o array<int>").select(values.axis_buckets(F.col("o"))).collect()
    assert [r[0] for r in empty] == [[], None, [None]]


def test_folding_takes_words_once_for_each_language(spark):
    rows = [("The Évolution of prices",), ("les taux du chômage",), ("the of",), ("",), (None,), ("bus glass boxes ﬁx",)]
    df = spark.createDataFrame(rows, "t string").select(text.fold(F.col("t"), text.detect_language(F.col("t"))).alias("f"), text.detect_language(F.col("t")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [("evolution price", "fr"), ("taux chomage", "fr"), ("the of", "en"), ("", "en"), (None, "en"), ("bus glass boxe fix", "en")]
    one = spark.createDataFrame(rows, "t string").select(text.fold(F.col("t"), F.lit("x")).alias("f"))
    assert one._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") <= 4

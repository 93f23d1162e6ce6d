"""Descriptive statistics. NaN and infinities are missing throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.values import finite, safe_div
from almanack.operators.order import mean_ranks, quantiles

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def statistics(value: Column, period: Column | None = None, total: bool = False) -> list[Column]:
    """All statistics of a column but quantiles as one set of aggregates: one shuffle for any number of columns.

    Variance needs two values, skewness three, kurtosis four, the variation coefficient values of one
    sign and a mean that is not zero.
    """
    x = finite(value)
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    out = [
        F.count(x).alias("count"),
        (F.count(F.lit(1)) - F.count(x)).alias("missing"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("std"),
        F.when((F.avg(x) != 0) & (F.min(x) >= 0), safe_div(F.stddev_samp(x), F.abs(F.avg(x)))).alias("cv"),
        F.when(n >= 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * g1).alias("skewness"),
        F.when(n >= 4, safe_div((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))).alias("kurtosis"),
    ]
    if period is not None:
        seen = F.when(x.isNotNull(), period)
        out += [F.min(seen).alias("first_period"), F.max(seen).alias("last_period"), F.count(seen).alias("periods_available")]
    return out + ([F.sum(x).alias("sum")] if total else [])


def describe_long(long: DataFrame, by: list[str], value: str = "value", period: str | None = "period", limit: int = 100_000) -> DataFrame:
    """One row of statistics for each group, exact quantiles (linear between places) among them."""
    rest = long.groupBy(*by).agg(*statistics(F.col(value), F.col(period) if period else None))
    q = quantiles(long, by, F.col(value), QUANTILES, limit).withColumnsRenamed({k: f"_of_{k}" for k in by}).drop("n")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by))
    shares = [F.get("q", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(QUANTILES)]
    return rest.join(q, same, "left").select(*rest.columns, *shares, (F.get("q", F.lit(3)) - F.get("q", F.lit(1))).alias("iqr"))


def describe_wide(wide: DataFrame, aliases: list[str]) -> DataFrame:
    """One row of statistics for each column."""
    cells = F.array(*(F.struct(F.lit(a).alias("alias"), F.col(f"`{a}`").alias("value")) for a in aliases))
    return describe_long(wide.select("period", F.explode(cells).alias("c")).select("period", "c.*"), ["alias"])


def covariance(x: Column, y: Column) -> Column:
    """Sample covariance over rows where both are numbers; null below two of them."""
    a, b = finite(x), finite(y)
    return F.covar_samp(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))


def covariance_exact(x: Column, y: Column, scale: int = 2) -> Column:
    """The same from exact decimal sums, so that it does not depend on the order of rows; values of ``scale`` places.

    Sums hold up to 38 digits together, which is 10^10 rows of values of ten digits.
    """
    a, b = finite(x.cast("double")).cast(f"decimal(14,{scale})"), finite(y.cast("double")).cast(f"decimal(14,{scale})")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    n = F.count(a)
    part = (F.sum(a).cast("double") * F.sum(b).cast("double")) / F.nullif(n, F.lit(0))
    return safe_div(F.sum((a * b).cast(f"decimal(28,{2 * scale})")).cast("double") - part, F.nullif((n - 1).cast("double"), F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over pairwise complete rows; null where a side is constant."""
    a, b = finite(x), finite(y)
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return safe_div(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def correlation_matrix(wide: DataFrame, aliases: list[str], method: str = "pearson") -> DataFrame:
    """(x, y, r, n) for all pairs of columns; the diagonal is 1.

    Pearson: every pair in one aggregate. Spearman: ranks of each pair's complete rows, with
    equal values sharing the mean rank, then Pearson of the ranks.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method: {method}")
    pairs = [(x, y) for i, x in enumerate(aliases) for y in aliases[i + 1 :]]
    cell = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), finite(F.col(f"`{x}`")).alias("a"), finite(F.col(f"`{y}`")).alias("b"))
    one = wide.sparkSession.createDataFrame([(a, a, 1.0, None) for a in aliases], "x string, y string, r double, n long")
    if not pairs:
        return one
    if method == "pearson":
        both = lambda x, y: F.count(F.when(finite(F.col(f"`{x}`")).isNotNull() & finite(F.col(f"`{y}`")).isNotNull(), 1))
        row = wide.agg(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), pearson(F.col(f"`{x}`"), F.col(f"`{y}`")).alias("r"), both(x, y).alias("n")) for x, y in pairs)).alias("p"))
        out = row.select(F.explode("p").alias("p")).select("p.*")
    else:
        long = wide.select(F.explode(F.array(*(cell(x, y) for x, y in pairs))).alias("c")).select("c.*").filter("a is not null and b is not null")
        rank = lambda c: mean_ranks(long, ["x", "y"], c).withColumnRenamed("rank", f"r{c}")
        ranked = long.join(rank("a"), ["x", "y", "a"]).join(rank("b"), ["x", "y", "b"])
        out = ranked.groupBy("x", "y").agg(pearson(F.col("ra"), F.col("rb")).alias("r"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(out).unionByName(out.select(F.col("y").alias("x"), F.col("x").alias("y"), "r", "n"))


def profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: type (numeric, text, other), distinct, missing; of numbers also mean, std, min, max, zeros, negatives."""
    kinds = {c: "numeric" if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else "text" if t == "string" else "other" for c, t in table.dtypes}
    cell = lambda c: F.struct(F.lit(c).alias("variable"), F.lit(kinds[c]).alias("kind"), (F.col(f"`{c}`").cast("double") if kinds[c] == "numeric" else F.lit(None).cast("double")).alias("v"), F.col(f"`{c}`").cast("string").alias("s"))
    long = table.select(F.explode(F.array(*(cell(c) for c in columns))).alias("c")).select("c.*")
    x = finite(F.col("v"))
    shown = F.when(F.col("kind") == "numeric", x.cast("string")).otherwise(F.col("s"))
    return long.groupBy("variable", "kind").agg(F.countDistinct(shown).alias("distinct"), F.count_if(shown.isNull()).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"))


def table_profile(table: DataFrame) -> DataFrame:
    """Rows, missing cells and duplicate rows of a table, in one row."""
    missing = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in table.columns), F.lit(0))
    groups = table.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("_n"), F.sum(missing).alias("_m"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_cells"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def profiling_sample(table: DataFrame, rows: int, columns: int) -> tuple[DataFrame, bool]:
    """The table, or exactly 10,000 rows of one that has over 250,000 cells and more rows than that.

    They are those with the smallest hashes, so every layout of the table gives the same sample; only
    rows that are near enough by their hash are sorted.
    """
    if rows * columns > 250_000 and rows > 10_000:
        mark, span = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in table.columns)), 1 << 30
        near = table.withColumn("_mark", mark).filter(F.pmod("_mark", F.lit(span)) < int(span * min(1.0, 13_000 / rows)))
        near = near if near.limit(10_000).count() == 10_000 else table.withColumn("_mark", mark)  # many rows may be one row
        return near.orderBy(F.pmod("_mark", F.lit(span)), "_mark").limit(10_000).drop("_mark"), True
    return table, False


def panel_balance(observations: DataFrame, key: Column) -> DataFrame:
    """Geographies, periods, expected and present cells, duplicates of each series."""
    cell = observations.groupBy("provider", "series_id", key.alias("geo_key"), "period").agg(F.count(F.lit(1)).alias("n"))
    out = cell.groupBy("provider", "series_id").agg(F.countDistinct("geo_key").alias("geographies"), F.countDistinct("period").alias("periods"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("n") - 1).alias("duplicates"))
    return out.withColumn("expected", F.col("geographies") * F.col("periods")).withColumn("balanced", (F.col("cells") == F.col("expected")) & (F.col("duplicates") == 0))


def economic_summary(observations: DataFrame, variables: DataFrame) -> DataFrame:
    """One row for each variable: role, geographies, periods, balance, coverage, units, frequencies.

    The role is ``level``, ``rate`` or ``index``, from the unit.
    """
    from almanack.functions.values import unit_family
    from almanack.operators.dataset import geo_key, named

    rows = named(observations, variables, "inner").withColumn("geo_key", geo_key())
    family = unit_family(F.col("unit"))
    role = F.when(family == "percent", "rate").when(family == "index", "index").otherwise("level")
    out = rows.groupBy("alias").agg(
        F.min(role).alias("role"),
        F.countDistinct("geo_key").alias("geographies"),
        F.countDistinct("period").alias("periods"),
        F.countDistinct("geo_key", "period").alias("cells"),
        F.count("value").alias("present"),
        F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("units"),
        F.array_join(F.array_sort(F.collect_set("frequency")), ",").alias("frequencies"),
    )
    return out.withColumn("balanced", F.col("cells") == F.col("geographies") * F.col("periods")).withColumn("coverage_pct", F.bround(safe_div(100 * F.col("present"), F.col("geographies") * F.col("periods")), 2))

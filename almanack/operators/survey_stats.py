"""Weighted samples: effective size, bounds, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def kish(weight: Column) -> Column:
    """Effective size of a weighted sample."""
    return F.try_divide(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def wilson_lower(p: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of a share; 0 without trials."""
    root = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (p + z * z / (2 * n) - root) / (1 + z * z / n))).otherwise(0.0)


def stratified_bound(rows: DataFrame, stratum: str, weight: str, success: str) -> DataFrame:
    """One row: the strata's weighted Wilson bounds, weighted by their shares, within [0, 1]; null outcomes are failures of none."""
    w, ok = F.col(weight), F.col(success).cast("double")
    each = rows.filter(F.col(success).isNotNull()).groupBy(stratum).agg(F.sum(w).alias("w"), kish(w).alias("n"), F.try_divide(F.sum(w * ok), F.sum(w)).alias("p"))
    each = each.withColumn("low", wilson_lower(F.col("p"), F.col("n")))
    share = F.try_divide(F.sum(F.col("w") * F.col("low")), F.sum("w"))
    return each.agg(F.count(F.lit(1)).alias("strata"), F.sum("n").alias("effective_n"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("lower_bound"))


def hash_ratio(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts: the same on every engine."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def split(ratio: Column, shares: dict[str, float]) -> Column:
    """The split whose cumulative share covers the ratio; the last takes what is left."""
    out, total = None, 0.0
    for name, share in list(shares.items())[:-1]:
        total += share
        out = F.when(ratio < total, name) if out is None else out.when(ratio < total, name)
    last = list(shares)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def allocate(strata: DataFrame, by: list[str], size: str, total: int) -> DataFrame:
    """(by..., places): floors of the strata's shares, then one more for the largest remainders, equal ones from the last key on.

    Remainders are whole numbers, so nothing depends on rounding. Null sizes are 0; no stratum gets more than its size.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("decimal(19,0)")
    rows = strata.select(*by, n.alias("_n"))
    everything = int(rows.agg(F.sum("_n")).first()[0] or 0)  # one number
    places = min(total, everything)
    if not everything:
        return rows.select(*by, F.lit(0).cast("long").alias("places"))
    dealt = rows.withColumn("_left", F.expr(f"(_n * {places}BD) % {everything}BD")).withColumn("places", F.expr(f"(_n * {places}BD) div {everything}BD"))
    more = places - int(dealt.agg(F.sum("places")).first()[0])
    extra = dealt.filter("_left > 0").orderBy(F.desc("_left"), *map(F.desc, by)).limit(more).select(*(F.col(k).alias(f"_of_{k}") for k in by), F.lit(1).alias("_more"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by))
    return dealt.join(extra, same, "left").select(*by, (F.col("places") + F.coalesce("_more", F.lit(0))).cast("long").alias("places"))

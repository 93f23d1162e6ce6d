"""Stored versions of observations: a manifest of digests by key range, so that what did not change is neither written nor read.

Keys are dealt into ranges of their hash. A version's manifest holds each range's number of rows, a digest that does not
depend on their order, and the version whose folder holds the rows: a range that equals that of the version before
stays where it is. The difference of two versions reads the ranges whose digests differ, of both, and nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.operators import diff
from almanack.operators.dataset import geo_key
from almanack.sources.landing import keep


def _range(ranges: int) -> Column:
    return F.pmod(F.xxhash64("provider", "series_id", geo_key(), "period"), F.lit(ranges)).cast("int")


def manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(range, n, digest, mixed, held_by) of a version; a row a range."""
    return spark.read.parquet(f"{path}/manifest/{version:06d}")


def write_version(rows: DataFrame, path: str, version: int, previous: int | None = None, ranges: int = 256) -> DataFrame:
    """Store a version and return its manifest; of ranges that equal those of ``previous`` only the reference is written.

    Versions that are compared must have the same number of ranges. Writing a version again replaces it.
    """
    spark, columns = rows.sparkSession, rows.columns
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    keyed = keep(rows.withColumn("range", _range(ranges)), "version")  # digests and rows are those of one reading
    mark = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in columns), F.hash(*(F.col(f"`{c}`").cast("string") for c in columns)))
    found = keyed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(mark.cast("decimal(20,0)")).alias("digest"), F.bit_xor(mark).alias("mixed"))
    if previous is None:
        new = found.withColumn("held_by", F.lit(version))
    else:
        before = manifest(spark, path, previous).withColumnRenamed("held_by", "before")
        new = found.join(before, ["range", "n", "digest", "mixed"], "left").withColumn("held_by", F.coalesce("before", F.lit(version))).drop("before")
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version:06d}")
    stored = manifest(spark, path, version)
    changed = [r.range for r in stored.filter(F.col("held_by") == version).select("range").collect()]  # a number a range
    fresh = keyed.filter(F.col("range").isin(changed)) if changed else keyed.filter("false")
    fresh.hint("rebalance", "range").write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows/{version:06d}")
    return stored


def read_version(spark: SparkSession, path: str, version: int, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its ranges; each is read where it is held."""
    where: dict[int, list[int]] = {}
    for r in manifest(spark, path, version).select("range", "held_by").collect():
        if only is None or r.range in only:
            where.setdefault(r.held_by, []).append(r.range)
    held = [spark.read.parquet(f"{path}/rows/{v:06d}").filter(F.col("range").isin(some)).drop("range") for v, some in sorted(where.items())]
    return reduce(DataFrame.unionByName, held) if held else spark.read.parquet(f"{path}/shape")


def changed_ranges(spark: SparkSession, path: str, previous: int, current: int) -> list[int]:
    """The ranges whose digests differ, or that only one of the versions has."""
    same = ["range", "n", "digest", "mixed"]
    old, new = (manifest(spark, path, v).select(*same) for v in (previous, current))
    return sorted(r.range for r in old.exceptAll(new).unionByName(new.exceptAll(old)).select("range").distinct().collect())


def changes(spark: SparkSession, path: str, previous: int, current: int, tolerance: float = 1e-9) -> DataFrame:
    """``diff.changes`` of two stored versions, from the ranges that differ."""
    only = changed_ranges(spark, path, previous, current)
    return diff.changes(read_version(spark, path, previous, only), read_version(spark, path, current, only), tolerance)

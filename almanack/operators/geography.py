"""Coverage of requested geographies, regions, and set operations on country lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """One row: how many of the requested came back, their share, and which did not."""
    flagged = requested.select(key).distinct().join(returned.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return flagged.agg(F.count(F.lit(1)).alias("requested"), F.count("_in").alias("covered"), F.try_divide(F.count("_in"), F.count(F.lit(1))).alias("ratio"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_in").isNull(), F.col(key)))), ",").alias("missing"))


def code_difference(codes: Column, known: Column) -> Column:
    """The codes of one provider's list that another's lacks, each once, in order."""
    return F.array_except(codes, known)


def missing(requested: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")


def expand(regions: DataFrame, members: str = "members") -> DataFrame:
    """A row for each member of each region."""
    return regions.select("*", F.explode(members).alias("member")).drop(members)


def follow_up(current: Column, added: Column, removed: Column) -> Column:
    """A country list after a follow-up's changes."""
    return F.array_except(F.array_union(current, added), removed)

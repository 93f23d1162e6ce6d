"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.storage import drop, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Only a per-node minimum is aggregated, so a hub costs one row per task."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = near.join(low, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    An empty table gives an empty result. Loops and repeated links are harmless. Rounds go on until
    nothing changes, which the two stars reach for every graph (their number grows with the square
    of the logarithm of a component's size at most); each round's table is deleted after the next.
    """
    spark = edges.sparkSession
    now = materialise(edges.filter("a <> b").select("a", "b").distinct(), "links")
    mark = None
    while True:
        new = materialise(_stars(_stars(now, True), False), "stars")
        drop(spark, now)
        now = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
    roots = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return roots.union(tops.join(roots, "node", "left_anti"))

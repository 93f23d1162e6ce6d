"""The driver's tables as canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals by nation and market segment; cents are summed exactly."""
    orders, customers, nations = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    out = rows.groupBy("n_nationkey", "n_name", "c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(total.alias("value"), F.min("o_orderkey").alias("obs_seq"), F.min("o_orderstatus").alias("status"))
    return out.select(F.lit("orders").alias("provider"), F.col("c_mktsegment").alias("series_id"), F.col("n_name").alias("geography"), F.lit(None).cast("string").alias("iso3"), "period", "value", F.lit("current us$").alias("unit"), F.lit("monthly").alias("frequency"), "status", "obs_seq")


def variables(spark: SparkSession) -> DataFrame:
    rows = [(s.lower(), "orders", s, f"Orders of {s.lower()}", "current us$", "monthly", "orders", None, i) for i, s in enumerate(SEGMENTS)]
    return spark.createDataFrame(rows, "alias string, provider string, series_id string, title string, unit string, frequency string, concept string, coverage_end string, ordinal int")


ALIASES = [s.lower() for s in SEGMENTS]


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue rows."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("D"), "doc_id").alias("code"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), F.col("source").alias("provider"), F.col("lang").alias("topic"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports by the supplier's nation, imports by the customer's: (nation, year, flow, value)."""
    items, orders, customers, suppliers = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    base = items.select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    out = base.join(suppliers, base.l_suppkey == suppliers.s_suppkey).select(F.col("s_nationkey").alias("nation"), "year", F.lit("export").alias("flow"), "value")
    buyers = orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", F.col("c_nationkey").alias("nation"))
    into = base.join(buyers, base.l_orderkey == buyers.o_orderkey).select("nation", "year", F.lit("import").alias("flow"), "value")
    return out.unionByName(into)

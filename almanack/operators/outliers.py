"""Outliers, flagged and never removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.functions.values import finite, round_even, safe_div
from almanack.operators.order import quantiles, with_group
from almanack.sources.landing import keep


def modified_z(rows: DataFrame, group: list[str], value: str = "value", threshold: float = 3.5, limit: int = 100_000) -> DataFrame:
    """Rows with ``score`` beyond the threshold, by median and MAD; by mean deviation where MAD is 0.

    Groups of under five numbers and constant ones have no score. Medians are selected by counted ranges.
    """
    x = keep(rows.withColumn("_x", finite(F.col(value))).filter("_x is not null"), "values")  # read by each pass below
    med = quantiles(x, group, F.col("_x"), (0.5,), limit).select(*group, F.get("q", F.lit(0)).alias("_m"), F.col("n").alias("_n")).filter("_n >= 5")
    med = keep(med, "medians")
    far = with_group(x, med, group).withColumn("_d", F.abs(F.col("_x") - F.col("_m")))
    mad = quantiles(far, group, F.col("_d"), (0.5,), limit).select(*group, F.get("q", F.lit(0)).alias("_mad"))
    mean = far.groupBy(*group).agg(F.avg("_d").alias("_mean"))
    dev = with_group(far, with_group(mad, mean, group), group)
    score = F.when(F.col("_mad") > 0, 0.6745 * (F.col("_x") - F.col("_m")) / F.col("_mad")).otherwise(safe_div(F.col("_x") - F.col("_m"), 1.253314 * F.col("_mean")))
    return dev.withColumn("score", score).filter(F.abs("score") >= threshold).drop("_x", "_m", "_n", "_d", "_mad", "_mean")


def z_scores(rows: DataFrame, group: list[str], value: str = "value", threshold: float = 3.0) -> DataFrame:
    """Rows at least ``threshold`` sample deviations from their group's mean; three numbers at least."""
    x = finite(F.col(value))
    limits = rows.groupBy(*group).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"), F.count(x).alias("_n"))
    out = rows.join(limits, group).withColumn("score", F.when(F.col("_n") >= 3, safe_div(x - F.col("_mean"), F.nullif(F.col("_sd"), F.lit(0.0)))))
    return out.filter(F.abs("score") >= threshold).withColumn("score", round_even(F.col("score"), 3)).drop("_mean", "_sd", "_n")


def iqr_fences(rows: DataFrame, group: list[str], value: str = "value", multiplier: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles by ``multiplier`` ranges, with the distance in ranges; four numbers at least."""
    x, q = finite(F.col(value)), quantiles(rows, group, F.col(value), (0.25, 0.75))
    limits = q.select(*group, F.get("q", F.lit(0)).alias("_q1"), F.get("q", F.lit(1)).alias("_q3"), F.col("n").alias("_n")).withColumn("_r", F.col("_q3") - F.col("_q1")).filter("_n >= 4 and _r <> 0")
    out = rows.join(limits, group).filter((x < F.col("_q1") - multiplier * F.col("_r")) | (x > F.col("_q3") + multiplier * F.col("_r")))
    far = F.when(x < F.col("_q1"), F.col("_q1") - x).otherwise(x - F.col("_q3"))
    return out.withColumn("distance", round_even(far / F.col("_r"), 3)).drop("_q1", "_q3", "_r", "_n")

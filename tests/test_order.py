"""Places, quantiles and ranks of groups that no task holds, against sorting in Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanack.operators import describe, order, outliers


def groups(seed):
    rng = random.Random(seed)
    one = [rng.choice([rng.gauss(0, 1), 10 ** rng.uniform(-300, 300), -(10 ** rng.uniform(-9, 9)), 5.0]) for _ in range(4000)]  # holds nearly all rows
    out = {"all": one, "same": [7.0] * 500, "two": [1.0] * 300 + [2.0] * 301, "few": [3.0, 1.0], "one": [4.0], None: [rng.random() for _ in range(250)], "near": [1 + i * 2**-52 for i in range(300)]}
    rows = [(k, v) for k, vs in out.items() for v in vs] + [("all", None), ("all", math.nan), ("all", math.inf), ("none", None), ("none", math.nan)]
    rng.shuffle(rows)
    return out, rows


@pytest.mark.parametrize("limit", [20, 200, 100_000])
def test_quantiles_of_skewed_groups(spark, limit):
    out, rows = groups(limit)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.k: (r.n, r.q) for r in order.quantiles(df, ["k"], F.col("v"), shares, limit).collect()}
    assert set(got) == set(out)  # a group without numbers has no row
    for k, vs in out.items():
        assert got[k][0] == len(vs)
        s = sorted(vs)
        for p, q in zip(shares, got[k][1]):
            at = p * (len(s) - 1)
            low, high = s[math.floor(at)], s[math.ceil(at)]
            assert q == (low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)


@pytest.mark.parametrize("limit", [30, 100_000])
def test_places(spark, limit):
    out, rows = groups(1)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r["values"] for r in order.places(df, ["k"], F.col("v"), [lambda n: n - 1, lambda n: F.lit(1), lambda n: F.lit(-1), lambda n: n], limit).collect()}
    for k, vs in out.items():
        s = sorted(vs)
        assert got[k] == [s[-1], s[1] if len(s) > 1 else None, None, None]
    mid = {r.k: r.median for r in order.upper_median(df, ["k"], F.col("v"), limit).collect()}
    assert mid == {k: sorted(v)[len(v) // 2] for k, v in out.items()}
    whole = order.upper_median(df, [], F.col("v"), limit).collect()
    assert [r.median for r in whole] == [sorted(v for vs in out.values() for v in vs)[sum(map(len, out.values())) // 2]]


def test_no_buffer_of_a_group(spark):
    """Plans of statistics hold no aggregate that keeps a group's values, and no window over all rows."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.0).alias("value"), F.col("id").cast("string").alias("period"))
    plans = [describe.describe_long(df, ["g"]), outliers.iqr_fences(df, ["g"]), outliers.modified_z(df, ["g"]), order.upper_median(df, ["g"], F.col("value"))]
    text = "\n".join(p._jdf.queryExecution().toString() for p in plans)
    assert "percentile(" not in text and "median(" not in text and "collect_list" not in text


def test_medians_of_one_large_group(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 3), 2) for _ in range(3000)] + [99.0, -99.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("s", 1.0)], "g string, value double").repartition(4)
    med = np.median(values)
    mad = np.median([abs(v - med) for v in values])
    expected = sorted((v, round(0.6745 * (v - med) / mad, 9)) for v in values if abs(0.6745 * (v - med) / mad) >= 3.5)
    for limit in (50, 100_000):
        assert sorted((r.value, round(r.score, 9)) for r in outliers.modified_z(df, ["g"], limit=limit).collect()) == expected


def test_mean_ranks_over_partitions(spark):
    rng = random.Random(3)
    rows = [("a", float(rng.randint(0, 900))) for _ in range(5000)] + [("a", 5.0)] * 3000 + [("b", 1.0), ("b", 1.0), ("b", 0.5)]
    got = {(r.g, r.v): r["rank"] for r in order.mean_ranks(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v").collect()}
    for g in "ab":
        vs = sorted(v for k, v in rows if k == g)
        first = {v: i for i, v in reversed(list(enumerate(vs, 1)))}
        assert all(got[g, v] == first[v] + (vs.count(v) - 1) / 2 for v in first)
    assert len(got) == len(set(rows))


def test_profiling_sample_is_the_same_in_every_layout(spark):
    df = spark.range(30_000).select("id", *((F.col("id") % k).alias(f"c{k}") for k in range(2, 12)))
    one, sampled = describe.profiling_sample(df.repartition(3), 30_000, 11)
    two, _ = describe.profiling_sample(df.repartition(7, "c5"), 30_000, 11)
    assert sampled and {r.id for r in one.collect()} == {r.id for r in two.collect()} and one.count() == 10_000
    same, _ = describe.profiling_sample(df.withColumn("id", F.lit(1)).select("id", *(F.lit(0).alias(f"c{k}") for k in range(2, 12))), 30_000, 11)
    assert same.count() == 10_000

"""Stored versions: what did not change is neither written nor read."""

import os

from pyspark.sql import functions as F

from almanack import schema
from almanack.operators import diff, versions


def rows(spark, n, change=lambda i: 0.0):
    return spark.createDataFrame([("p", f"s{i % 7}", "X", None if i % 3 else "XXX", str(1000 + i), i + change(i), "u", "annual", None, i) for i in range(n)], schema.OBSERVATIONS)


def files(path):
    return {os.path.join(d.removeprefix(path), f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def key(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_only_changed_ranges_are_written_and_read(spark, tmp_path):
    path = str(tmp_path)
    first, second = rows(spark, 600), rows(spark, 600, lambda i: 0.5 * (i == 77))
    versions.write_version(first, path, 0, ranges=20)
    versions.write_version(second.repartition(5), path, 1, 0, ranges=20)
    changed = versions.changed_ranges(spark, path, 0, 1)
    assert len(changed) == 1
    assert {f.split("/")[2] for f in files(f"{path}/rows/000001")} <= {f"range={changed[0]}"} or len(files(f"{path}/rows/000001")) == 1
    assert files_read(versions.read_version(spark, path, 1, changed)) < files_read(versions.read_version(spark, path, 1))
    show = lambda df: sorted((r.period, r.old, r.new, r.change) for r in df.collect())
    assert show(versions.changes(spark, path, 0, 1)) == show(diff.changes(first, second)) == [("1077", 77.0, 77.5, "updated")]
    assert key(versions.read_version(spark, path, 1)) == key(second)
    assert key(versions.read_version(spark, path, 0)) == key(first)


def test_new_removed_and_repeated_rows(spark, tmp_path):
    path = str(tmp_path)
    first, second = rows(spark, 50), rows(spark, 60).filter("period <> '1003'")
    versions.write_version(first.filter("false"), path, 0, ranges=8)
    assert versions.read_version(spark, path, 0).count() == 0
    versions.write_version(first.unionByName(first), path, 1, 0, ranges=8)
    versions.write_version(second, path, 2, 1, ranges=8)
    versions.write_version(second.orderBy(F.rand(1)), path, 3, 2, ranges=8)
    count = lambda a, b: {r.change: r["count"] for r in versions.changes(spark, path, a, b).groupBy("change").count().collect()}
    assert count(0, 1) == {"new": 50} and count(1, 2) == {"new": 10, "removed": 1} and count(2, 3) == {} and versions.changed_ranges(spark, path, 2, 3) == []
    assert files(f"{path}/rows/000003") == set() and versions.read_version(spark, path, 3).count() == 59
    versions.write_version(first, path, 3, 2, ranges=8)  # a version again
    assert count(2, 3) == {"new": 1, "removed": 10}

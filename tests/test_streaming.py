import time

from almanack import schema
from almanack.streaming import streams


def test_refresh_makes_versions(spark, tmp_path):
    row = lambda y, v: ("p", "s", "X", "XXX", str(y), v, "u", "annual", None, y)
    landing = str(tmp_path / "in")
    found = []

    def arrive(rows):
        spark.createDataFrame(rows, schema.OBSERVATIONS).coalesce(1).write.mode("append").parquet(landing)
        streams.refresh(streams.watch(spark, landing, schema.OBSERVATIONS), str(tmp_path / "out"), str(tmp_path / "cp"), lambda n, r: found.append((n, *r[0]))).awaitTermination()

    arrive([row(2000, 1.0), row(2001, 2.0)])
    arrive([row(2000, 1.5), row(2002, 3.0)])
    assert found == [(1, 1, 1, 1)]
    assert spark.read.parquet(str(tmp_path / "out" / "version=0")).count() == 2


def test_windows_agree_with_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 01:00:00"), (1, "2024-01-01 03:00:00")], "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp_ntz) ts")
    events.write.parquet(str(tmp_path / "e"))
    stream = streams.watch(spark, str(tmp_path / "e"), events.schema)
    for n, (plan, rows) in enumerate(((streams.tumbling(stream, ["user_id"], "1 hour"), 3), (streams.sessions(stream, ["user_id"], "30 minutes"), 3), (streams.sliding(stream, ["user_id"], "1 hour", "30 minutes"), 6))):
        plan.writeStream.format("memory").queryName(f"q{n}").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"q{n}").count() == rows


def test_fold_stream_agrees_with_batch_over_a_restart(spark, tmp_path):
    spark.conf.set(*streams.STATE_STORE)
    turns = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", None), (2, 0, "user", "xyz"), (1, 2, "user", "c"), (3, 0, "tool", "t")], "conv_id long, turn long, role string, text string")
    last = {}

    def arrive(rows, **how):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        plan = streams.fold_stream(streams.watch(spark, str(tmp_path / "t"), turns.schema), **how)
        keep = lambda batch, n: last.update({r.conv_id: tuple(r) for r in batch.collect()})
        plan.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    arrive(turns.filter("turn < 1"))
    arrive(turns.filter("turn >= 1"))
    assert sorted(last.values()) == sorted(map(tuple, streams.fold_batch(turns).collect()))


def test_a_quiet_conversation_starts_anew(spark, tmp_path):
    spark.conf.set(*streams.STATE_STORE)
    schema = "conv_id long, turn long, role string, text string"
    seen = []

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        count, until = len(seen), time.monotonic() + 60
        while len(seen) == count and time.monotonic() < until:
            time.sleep(0.2)

    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "t"))
    plan = streams.fold_stream(streams.watch(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema), quiet_ms=3000)
    query = plan.writeStream.foreachBatch(lambda b, n: seen.extend((r.conv_id, r.turns) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        arrive((1, 0, "user", "a"))
        time.sleep(6)  # the timer goes off in a batch without rows
        arrive((1, 1, "user", "b"))
    finally:
        query.stop()
    assert seen == [(1, 1), (1, 1)]


def test_a_fold_without_timers_needs_no_python(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, None, "ab"), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "t"))
    plan = lambda **how: streams.fold_stream(streams.watch(spark, str(tmp_path / "t"), turns.schema), **how)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan() and "TransformWithState" in plan(quiet_ms=5)

"""Structured Streaming: refreshes, event windows, and keyed folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from almanack.operators.diff import change_counts


def watch(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    """Files as they land, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def refresh(arrivals: DataFrame, versions: str, checkpoint: str, report: Callable[[int, list], None] | None = None) -> StreamingQuery:
    """Each batch becomes a version of its own under ``versions``; earlier ones stay.

    A version's folder is written over when its batch runs again, so a restart repeats nothing. The
    difference to the version before is reported.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{versions}/version={number}")
        if report and number:
            old, new = (spark.read.parquet(f"{versions}/version={n}") for n in (number - 1, number))
            report(number, change_counts(old, new).collect())

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, by: list[str], width: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _timed(events, ts, late).groupBy(*by, F.window(ts, width)).agg(F.count(F.lit(1)).alias("events"))


def sliding(events: DataFrame, by: list[str], width: str, step: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _timed(events, ts, late).groupBy(*by, F.window(ts, width, step)).agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, by: list[str], gap: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _timed(events, ts, late).groupBy(*by, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))


_TURNS = "conv_id long, turns long, user_turns long, last_role string, chars long"


def fold_batch(turns: DataFrame) -> DataFrame:
    """A conversation's state after its last turn, in one aggregate."""
    order = F.struct("turn", "role")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max_by("role", order).alias("last_role"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"))


class Conversation(StatefulProcessor):
    """A conversation's state as one typed value, and a timer that clears it when no turn came for ``quiet_ms``."""

    def __init__(self, quiet_ms: int | None) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("conversation", "turns long, users long, chars long, at long, last string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, users, chars, at, last = self.state.get() or (0, 0, 0, -1, "")
        for p in rows:
            n, users, chars = n + len(p), users + int((p["role"] == "user").sum()), chars + int(p["text"].fillna("").str.len().sum())
            top = p.sort_values(["turn", "role"]).iloc[-1]
            if int(top["turn"]) >= at:
                at, last = int(top["turn"]), str(top["role"])
        self.state.update((n, users, chars, at, last))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "user_turns": [users], "last_role": [last], "chars": [chars]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


#: Where the state of ``fold_stream`` has to be kept; set it on the session before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fold_stream(turns: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """The same state, kept for each conversation while turns arrive; after ``quiet_ms`` without one it starts anew.

    Without that (None: never) no timer is needed, and the fold of a batch is itself the streaming aggregate.
    """
    if quiet_ms is None:
        return fold_batch(turns)
    return turns.groupBy("conv_id").transformWithStateInPandas(Conversation(quiet_ms), _TURNS, "Update", "processingTime")


def breaker(calls: DataFrame, failures: int = 5, within: int = 300) -> DataFrame:
    """Calls (provider, seconds, ok) at which a circuit would open: the n-th failure within the window.

    Calls are dealt out by provider and time bucket of the window's width, each bucket with the failures
    of the one before, so a provider with most of the calls is many tasks.
    """
    own = calls.withColumn("_b", F.floor(F.col("seconds") / (within + 1))).withColumn("_own", F.lit(True))
    before = own.filter(~F.col("ok")).withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy("provider", "_b").orderBy("seconds").rangeBetween(-within, 0)
    out = own.unionByName(before).withColumn("recent", F.count_if(~F.col("ok")).over(w))
    return out.filter(F.col("_own") & ~F.col("ok") & (F.col("recent") >= failures)).drop("_b", "_own")


@dataclass(frozen=True)
class Breaker:
    """``failures`` within ``within`` seconds open a circuit for ``open_for``; then ``successes`` in a row close it."""

    failures: int = 5
    within: int = 300
    open_for: int = 60
    successes: int = 2


_STATES = "provider string, seconds long, ok boolean, state string"


def _advance(memory: tuple[str, int, int, list[int]], seconds: int, ok: bool, rule: Breaker) -> tuple[str, int, int, list[int]]:
    """(state, since, successes, failure times) after one call."""
    state, since, good, bad = memory
    if state == "open" and seconds - since >= rule.open_for:
        state, since, good = "half_open", seconds, 0
    if state == "half_open":
        if not ok:
            return "open", seconds, 0, []
        return ("closed", seconds, 0, []) if good + 1 >= rule.successes else (state, since, good + 1, bad)
    if state == "closed" and not ok:
        bad = [t for t in bad if seconds - t <= rule.within] + [seconds]
        return ("open", seconds, 0, []) if len(bad) >= rule.failures else (state, since, 0, bad)
    return state, since, good, bad


def _follow(batches: Iterator[pd.DataFrame], rule: Breaker) -> Iterator[pd.DataFrame]:
    """The states of sorted calls; what a circuit remembers goes on from batch to batch."""
    of, memory = object(), ("closed", 0, 0, [])
    for batch in batches:
        states = []
        for provider, seconds, ok in batch[["provider", "seconds", "ok"]].itertuples(index=False):
            if provider != of:
                of, memory = provider, ("closed", 0, 0, [])
            memory = _advance(memory, int(seconds), bool(ok), rule)
            states.append(memory[0])
        yield batch.assign(state=states)


def breaker_states(calls: DataFrame, rule: Breaker = Breaker(), timers: bool = True) -> DataFrame:
    """The state of a provider's circuit after each call (closed, open, half_open), as calls stream in.

    Works on streams and, through the same function, on tables. A circuit holds at most ``failures``
    times; without calls for ``open_for`` seconds of processing time a stream reports an open one as half
    open. ``timers`` off leaves that out: a stream that only works off what is there (``availableNow``)
    would wait for its timers for ever.
    """

    def run(provider: str, rows: pd.DataFrame, memory: tuple) -> tuple[pd.DataFrame, tuple]:
        out = []
        for seconds, ok in rows.sort_values(["seconds", "ok"])[["seconds", "ok"]].itertuples(index=False):
            memory = _advance(memory, int(seconds), bool(ok), rule)
            out.append((provider, int(seconds), bool(ok), memory[0]))
        return pd.DataFrame(out, columns=["provider", "seconds", "ok", "state"]), memory

    base = calls.select("provider", F.col("seconds").cast("long"), "ok")
    if not calls.isStreaming:
        # In order, a batch at a time: a provider with most of the calls is one task, and never one frame.
        return base.repartition("provider").sortWithinPartitions("provider", "seconds", "ok").mapInPandas(lambda batches: _follow(batches, rule), _STATES)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory = state.get if state.exists else ("closed", 0, 0, [])
        if state.hasTimedOut:
            name, since, good, bad = memory
            name = "half_open" if name == "open" else name
            state.update((name, since, good, bad))
            yield pd.DataFrame({"provider": [key[0]], "seconds": [since + rule.open_for], "ok": [None], "state": [name]})
            return
        rows = pd.concat(list(parts))
        out, memory = run(key[0], rows, (memory[0], memory[1], memory[2], list(memory[3])))
        state.update(memory)
        if timers and memory[0] == "open":
            state.setTimeoutDuration(rule.open_for * 1000)
        yield out

    return base.groupBy("provider").applyInPandasWithState(step, _STATES, "state string, since long, good int, bad array<long>", "append", "ProcessingTimeTimeout" if timers else "NoTimeout")


class Progress(StreamingQueryListener):
    """Hands each batch's progress on: name, batch, rows, rows a second, and how a query ended."""

    def __init__(self, report: Callable[[dict], None]) -> None:
        self.report = report

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.report({"event": "started", "query": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.report({"event": "progress", "query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.report({"event": "idle", "query": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.report({"event": "ended", "query": str(event.id), "error": event.exception})


def live_datasets(registry: DataFrame, now: Column, hours: int = 6, most: int = 200) -> DataFrame:
    """Registered datasets (id, created) that are kept: younger than ``hours``, and of those the ``most`` youngest."""
    young = registry.filter(F.col("created") > now - F.make_interval(hours=F.lit(hours)))
    return young.orderBy(F.desc("created"), "id").limit(most)


#: Seconds that a cached answer stays fresh, by the frequency of its data.
CACHE_SECONDS = {"daily": 3600, "weekly": 21_600, "monthly": 86_400, "quarterly": 86_400, "annual": 604_800}


def cache_state(entries: DataFrame, now: Column, seconds: dict[str, int] = CACHE_SECONDS, otherwise: int = 3600) -> DataFrame:
    """Cached answers (key, frequency, stored) with their age, and whether they are fresh or stale; stale ones may still be read."""
    keep = F.coalesce(F.create_map(*(F.lit(x) for kv in seconds.items() for x in kv))[F.col("frequency")], F.lit(otherwise))
    age = F.unix_timestamp(now) - F.unix_timestamp("stored")
    return entries.withColumn("age", age).withColumn("state", F.when(age <= keep, "fresh").otherwise("stale"))

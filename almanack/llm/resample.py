"""Importance resampling towards a target text: bucket gains, Gumbel keys, a distributed quickselect.

Each document's features (runs of one to ``ngrams`` words) are counted in hashed buckets, over all
documents and over all target texts. A bucket's gain is the logarithm of how much more often it is
used by the target; a document's weight is the sum of the gains of its features, looked up in an
array. A document's score is its weight plus a Gumbel number that only its id decides, so that the
highest scores are a draw without replacement in proportion to exp(weight).

The draw is a quickselect: random pivot keys are taken from what is left, one pass counts the keys below
and equal to each pivot exactly, and the range that holds the k-th key is what is left. Only the
winners are sorted, by ranges, and numbered by the counts of the ranges before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.llm import textcore
from almanack.llm.storage import materialise

#: Digits, letters a-z after lower-casing, and every byte of what is not ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@dataclass(frozen=True)
class ResampleConfig:
    """``percent`` of the documents with ``min_words`` words at least are drawn; ``pivots`` a round."""

    ngrams: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024
    pivots: int = 24


def bucketed(texts: pa.Array, config: ResampleConfig) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, words of each row, features' rows, features' buckets) for slices of a batch."""
    for lo, hi, data, offs in textcore.slices(texts):
        low = textcore.LOWER[data]
        starts, ends = textcore.runs(_WORD[low], offs)
        first = np.searchsorted(starts, offs)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        crc, rows, found = np.zeros(0, dtype=np.uint32), [], []
        for k in range(config.ngrams):
            n = len(starts) - k
            if n <= 0:
                break
            crc = textcore.crc32(low, starts[k:], ends[k:], textcore.crc32_bytes(0x20, crc[:n]) if k else None)
            inside = row[:n] == row[k:]
            rows.append(row[:n][inside])
            found.append((crc % np.uint32(config.buckets))[inside].astype(np.int64))
        none = np.zeros(0, dtype=np.int64)
        yield lo, hi, np.diff(first), np.concatenate(rows) if rows else none, np.concatenate(found) if found else none


def bucket_counts(texts: DataFrame, text_col: str = "text", config: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """Features in each bucket over all rows; each task sends one number a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, dtype=np.int64)
        for batch in batches:
            for *_, buckets in bucketed(batch.column(0), config):
                total += np.bincount(buckets, minlength=config.buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(config.buckets, dtype=np.int64)  # one number for each of ``buckets``
    for r in found:
        out[r.bucket] = r.n
    return out


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    every, wanted, n = int(docs.sum()), int(target.sum()), len(docs)
    ratio = lambda s, t: (float(t + 1) * float(every + n)) / (float(s + 1) * float(wanted + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel(seed: int, doc_id: str) -> int:
    """floor(1000 times) the standard Gumbel number that the seed and the id give."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row, inside the scan; the gains travel as one array."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)
    kind = docs.schema[id_col].dataType
    shape = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    names = shape.fieldNames()
    base = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for lo, hi, n, rows, buckets in bucketed(batch.column(2), config):
                words[lo:hi], features[lo:hi] = n, np.bincount(rows, minlength=hi - lo)
                weight[lo:hi] = np.bincount(rows, weights=table[buckets], minlength=hi - lo).astype(np.int64)  # sums stay below 2^53
            noise = np.array([gumbel(config.seed, i) for i in batch.column(1).to_pylist()], dtype=np.int64)
            yield pa.record_batch([batch.column(0), *map(pa.array, (words, features, weight, weight + noise))], names=names)

    return base.mapInArrow(run, shape)


def composite_key(id_col: str) -> Column:
    """What the draw orders by, least first: high scores, then small ids (null last), then few features."""
    return F.struct((-F.col("score")).alias("s"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("n_features").alias("n"))


def kth_key(keys: DataFrame, k: int, config: ResampleConfig = ResampleConfig()) -> Column | None:
    """The k-th smallest value of column ``key`` (from 1), as a literal; None if there are fewer.

    What is left shrinks by about the number of pivots in each round. Equal keys are one pivot, and are
    counted apart from what is below, so repeated keys end the search instead of prolonging it.
    """
    shape = keys.schema["key"].dataType
    literal = lambda row: F.struct(*(F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in shape.fields))
    left, asked, turn = keys, k, 0
    while asked > 0:
        turn += 1
        drawn = [r.key for r in left.orderBy(F.xxhash64(F.col("key"), F.lit(config.seed + turn))).limit(config.pivots).collect()]  # ``pivots`` keys
        if not drawn:
            return None
        pivots = sorted(set(drawn), key=lambda p: tuple((v is not None, v) for v in p))
        line = F.array(*map(literal, pivots))
        place = F.size(F.filter(line, lambda p: p < F.col("key")))
        found = left.groupBy(place.alias("place"), F.array_contains(line, F.col("key")).alias("same")).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows a pivot, and one
        at = {(r.place, r.same): r.n for r in found}
        total = sum(at.values())
        if asked > total:
            return None
        equal = [at.get((i, True), 0) for i in range(len(pivots))]
        below = [sum(n for (place, same), n in at.items() if place < i or (place == i and not same)) for i in range(len(pivots))]
        parts = list(zip(below, equal, pivots, strict=True))
        for less, same, pivot in parts:
            if less < asked <= less + same:
                return literal(pivot)
        low = max((x for x in parts if x[0] + x[1] < asked), key=lambda x: x[0], default=None)
        high = min((x for x in parts if x[0] >= asked), key=lambda x: x[0], default=None)
        if low:
            left, asked = left.filter(F.col("key") > literal(low[2])), asked - low[0] - low[1]
        if high:
            left = left.filter(F.col("key") < literal(high[2]))
    return None


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with their place (from 1) in the order of ``key``, without one task that sees them all.

    Ranges of the key are sorted and stored with each row's place in its range; the counts of the ranges
    before it do the rest. Equal keys are dealt over ranges by a random number, as any order of them will do.
    """
    ranged = rows.withColumn("_r", F.rand(7)).repartitionByRange("key", "_r").sortWithinPartitions("key", "_r")
    stored = materialise(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), name)
    sizes = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one number a partition
    before, total = {}, 0
    for part, n in sizes:
        before[part], total = total, total + n
    offset = F.create_map(*(F.lit(x).cast("long") for p in before.items() for x in p))[F.col("_part").cast("long")] if before else F.lit(0)
    return stored.withColumn("rank", (offset + F.col("_at") + 1).cast("long")).drop("_r", "_part", "_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """(id, n_features, weight, score, rank): every document, and its place if it is drawn (else null).

    Null and empty texts have no words, so weight 0, and are not drawn unless ``min_words`` is 0. Ties go
    to the smaller id, null ids (whose Gumbel number is that of an empty id) last. Repeated rows are
    documents each; of equal rows any may be the one that is drawn. Very long texts are scored whole. Empty
    tables give an empty result; an empty target leaves the smoothing alone to decide. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, config), bucket_counts(target, target_col, config))
    scored = materialise(score_documents(docs, gains, id_col, text_col, config), "scored").withColumn("key", composite_key(id_col))
    able = scored.filter(F.col("n_words") >= config.min_words)
    asked = config.percent * able.count() // 100
    last = kth_key(able.select("key"), asked, config)
    columns = [F.col(f"`{id_col}`"), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*columns, none)
    drawn = (F.col("n_words") >= config.min_words) & (F.col("key") <= last)
    winners = numbered(scored.filter(drawn), "winners")
    rank = F.when(F.col("rank") <= asked, F.col("rank")).alias("rank")  # beyond: rows equal to the last one
    return winners.select(*columns, rank).unionByName(scored.filter(~drawn).select(*columns, none))


def drawn_documents(docs: DataFrame, draw: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the drawn ids, with all their columns."""
    return docs.join(draw.filter("rank is not null").select(id_col).distinct(), id_col, "left_semi")

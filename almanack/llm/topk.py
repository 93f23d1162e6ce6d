"""Exact top-k inner products on a bit-sliced index.

Components become integers ``floor(scale * x)``. A block of vectors is stored as bitmaps: for each
dimension, one bitmap for each of its ``slices`` most significant bits (after an offset that makes
it non-negative). For a query, each slice is added as often as the bits of the query's weight say,
with bitwise full adders; a negative weight uses the complement. The sums are bitmaps again: from the
most significant one downward they yield the k-th largest sum. What the slices leave out is
bounded, so all rows within that bound of the k-th are boundary rows: their scores are computed
exactly. Nothing is approximate in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.storage import materialise

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class BsiConfig:
    """``block``: vectors of an index block; ``queries``: queries that travel together; ``lane_blocks``:
    blocks of the parts that the index is dealt to (each part gets every query once)."""

    k: int = 10
    scale: int = 1024
    slices: int = 8
    block: int = 4096
    queries: int = 128
    lane_blocks: int = 4


def quantise(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and their integers: not null, no null or non-finite component.

    A component whose integer does not fit 64 bits fails the job: no score could be given for it.
    """
    keep, out = [], []
    for i, v in enumerate(vectors):
        x = v.values
        if x is None or x.null_count:
            continue
        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            x = np.floor(x * scale)
            if (np.abs(x) >= 2.0**62).any():
                raise OverflowError("a component is too large for an integer of 64 bits")
            keep.append(i)
            out.append(x.astype(np.int64))
    return np.array(keep, dtype=np.int64), out


def inner(ints: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond the range of 64-bit sums by Python's integers, and an error if one does not fit."""
    most = max((abs(int(x)) for x in (ints.min(initial=0), ints.max(initial=0))), default=0)
    if most * sum(abs(x) for x in query.tolist()) < 1 << 63:
        return ints @ query
    exact = ints.astype(object) @ query.astype(object)
    if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
        raise OverflowError("a score does not fit an integer of 64 bits")
    return exact.astype(np.int64)


class Block:
    """Bitmaps of some vectors of one length."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, slices: int) -> None:
        self.ids, self.ints = ids, ints
        self.rows, self.dims = ints.shape
        self.low = ints.min(axis=0) if self.rows else np.zeros(self.dims, dtype=np.int64)
        above = (ints - self.low).astype(np.uint64)
        bits = int(above.max()).bit_length() if above.size else 0
        self.shift = max(0, bits - slices)
        self.bits = max(1, bits - self.shift)
        top = above >> np.uint64(self.shift)
        self.words = max(1, -(-self.rows // 64))
        flags = np.zeros((self.dims, self.bits, self.words * 64), dtype=np.uint8)
        for b in range(self.bits):
            flags[:, b, : self.rows] = ((top >> np.uint64(b)) & np.uint64(1)).T
        packed = np.packbits(flags, axis=2, bitorder="little").view(np.uint64).reshape(self.dims * self.bits, self.words)
        self.planes = np.concatenate([packed, packed ^ _ALL])
        self.inside = np.packbits((np.arange(self.words * 64) < self.rows).astype(np.uint8), bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of each row's weighted sum, least significant first; the most that it may be too low."""
        weight, negative = np.abs(query), query < 0
        wide = int(weight.max()).bit_length() if len(weight) else 0
        out, carry = [], np.zeros((0, self.words), dtype=np.uint64)
        level = 0
        while level < wide + self.bits - 1 or len(carry):
            picks = []
            for b in range(max(0, level - wide + 1), min(self.bits, level + 1)):
                d = np.flatnonzero((weight >> (level - b)) & 1)
                picks.append((d + self.dims * negative[d]) * self.bits + b)
            picks = np.concatenate(picks) if picks else np.zeros(0, dtype=np.int64)
            now, up = np.concatenate([self.planes[picks], carry]), []
            while len(now) > 2:
                n = len(now) // 3
                a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
                half = a ^ b
                up.append((a & b) | (c & half))
                now = np.concatenate([half ^ c, now[3 * n :]])
            if len(now) == 2:
                up.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
            out.append(now[0] if len(now) else np.zeros(self.words, dtype=np.uint64))
            carry = np.concatenate(up) if up else now[:0]
            level += 1
        return out, sum(weight.tolist()) if self.shift else 0

    def best(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k best (of any tie order) are for sure."""
        if self.rows <= k:
            return np.arange(self.rows)
        sums, slack = self.sums(query)
        sure, open_, kth = np.zeros(self.words, dtype=np.uint64), self.inside, 0
        for level in range(len(sums) - 1, -1, -1):
            with_bit = sure | (open_ & sums[level])
            if int(np.bitwise_count(with_bit).sum()) >= k:
                open_ = open_ & sums[level]
                kth |= 1 << level
            else:
                sure, open_ = with_bit, open_ & ~sums[level]
        least = kth - slack
        if least <= 0:
            return np.arange(self.rows)
        more, same = np.zeros(self.words, dtype=np.uint64), self.inside
        for level in range(max(len(sums), least.bit_length()) - 1, -1, -1):
            plane = sums[level] if level < len(sums) else np.zeros(self.words, dtype=np.uint64)
            if least >> level & 1:
                same = same & plane
            else:
                more, same = more | (same & plane), same & ~plane
        return np.flatnonzero(np.unpackbits((more | same).view(np.uint8), bitorder="little"))

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but the query's own, ties to the smaller id."""
        if len(query) != self.dims:
            return self.ids[:0], self.ids[:0]
        rows = self.best(query, k + int(np.count_nonzero(self.ids == own)))
        rows = rows[self.ids[rows] != own]
        score = inner(self.ints[rows], query)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", config: BsiConfig = BsiConfig()) -> DataFrame:
    """(block, dims, ids, ints) of every vector that takes part, built where the rows are: no shuffle."""
    base = vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).filter(F.col(id_col).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            some = held.pop(dims)
            made += 1
            ids, ints = np.array([i for i, _ in some], dtype=np.int64), np.concatenate([v for _, v in some])
            ints = ints.astype(np.int32) if np.abs(ints).max(initial=0) < 1 << 31 else ints
            return pa.record_batch([pa.array([(part << 24) + made]), pa.array([dims], pa.int32()), pa.array([ids.tobytes()]), pa.array([ints.tobytes()])], names=["block", "dims", "ids", "ints"])

        for batch in batches:
            keep, ints = quantise(batch.column(1), config.scale)
            for i, v in zip(batch.column(0).to_numpy()[keep].tolist(), ints, strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == config.block:
                    yield block(len(v))
        for dims in list(held):
            yield block(dims)

    return materialise(base.mapInArrow(run, "block long, dims int, ids binary, ints binary"), "index")


def pack_queries(vectors: DataFrame, id_col: str, vector_col: str, config: BsiConfig) -> DataFrame:
    """Queries in packs; of several vectors with one id that take part, the least one asks."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = base.filter(F.col("id").isNotNull() & finite).groupBy("id").agg(F.min("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ints = quantise(batch.column(1), config.scale)
            ids = batch.column(0).to_numpy()[keep]
            for a in range(0, len(ids), config.queries):
                some = ints[a : a + config.queries]
                yield pa.record_batch([pa.array([ids[a : a + config.queries].tobytes()]), pa.array([np.array([len(v) for v in some], dtype=np.int64).tobytes()]), pa.array([np.concatenate(some).tobytes()])], names=["q_ids", "q_dims", "q_ints"])

    return base.mapInArrow(run, "q_ids binary, q_dims binary, q_ints binary")


def top_k(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", config: BsiConfig = BsiConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors, all but those with its own id.

    Ties go to the smaller id. Null vectors, and those with a null or non-finite component or a
    null id take no part; neither do vectors of another length than the query's. Rows that repeat an
    id are candidates each; as a query an id asks once, with the least of its vectors in the order of
    arrays. Empty tables give an empty result. A score that does not fit 64 bits is an error.
    """
    index = build_index(vectors, id_col, vector_col, config)
    lanes = max(1, -(-index.count() // config.lane_blocks))
    index = index.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    asked = pack_queries(queries, id_col, vector_col, config).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                key, dims, ids, ints, q_ids, q_dims, q_ints = (batch.column(c)[r].as_py() for c in range(7))
                if key != name:
                    ids = np.frombuffer(ids, dtype=np.int64)
                    ints = np.frombuffer(ints, dtype=np.int32 if len(ints) == 4 * dims * len(ids) else np.int64).astype(np.int64)
                    name, block = key, Block(ids, ints.reshape(-1, dims), config.slices)
                ends = np.cumsum(np.frombuffer(q_dims, dtype=np.int64))
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for own, q in zip(np.frombuffer(q_ids, dtype=np.int64).tolist(), np.split(np.frombuffer(q_ints, dtype=np.int64), ends[:-1]), strict=True):
                    found, score = block.top(q, own, config.k)
                    out.append((own, found, score))
                yield pa.record_batch([pa.array(np.repeat([o for o, _, _ in out], [len(f) for _, f, _ in out])), pa.array(np.concatenate([f for _, f, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))], names=["query_id", "vec_id", "score"])

    pairs = index.join(asked.hint("merge"), "lane").select("block", "dims", "ids", "ints", "q_ids", "q_dims", "q_ints")
    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by inner product: an inverted multi-index.

The two halves of the vectors are quantised separately, each to its own centroids, so that few
centroids make many cells (pairs of them). A pair's distance to a query is the sum of what its two
centroids say: the negated inner product of the half, less ``reach`` times the spread of the half's
residuals around that centroid, as entries of a wide cell may be better than its centroid.

A search goes over the index twice. First a heap hands out the pairs by summed distance until their cells
hold ``first`` entries; those are scored, and the k-th best score is a bound. Then every pair whose
summed distance allows a better score is visited, and its entries are reranked by exact scores. Equal
vectors are one entry with as many of their ids as any result can hold, so hot vectors cost no more
than others. Large cells are divided over lanes; a query travels only to lanes with cells that it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.storage import materialise


@dataclass(frozen=True)
class MultiIndexConfig:
    """``fit_rows``: distinct vectors that the centroids are fitted on, at most; ``entries``: of a cell, on average, which
    sets the number of centroids of a half up to ``most``; ``reach``: offset and slope of the residual's part
    over the normal quantile of k among the entries, measured for a recall of about 0.97. ``block``: entries of a lane,
    at most; small tables have smaller lanes, so that there is one for each core."""

    k: int = 20
    fit_rows: int = 20_000
    entries: int = 8
    most: int = 256
    rounds: int = 8
    first: int = 32
    reach: tuple[float, float] = (1.3, 0.3)
    block: int = 8192
    queries: int = 512
    seed: int = 5


def proper(vector: Column) -> Column:
    """Whether a vector takes part: no null, no null or non-finite component, and one that is not zero."""
    x = lambda f: lambda v: f(v.cast("double"))
    good = F.forall(vector, x(lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, x(lambda v: v != 0))


def rows_of(vectors: pa.Array, dims: int) -> np.ndarray:
    """A matrix of doubles; -0.0 becomes 0.0."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    return flat.reshape(-1, dims)


def centroids(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means on the distinct rows, from rows drawn at random; fewer centroids if there are fewer rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, at)
        n = np.bincount(near, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        at[n > 0] = total[n > 0] / n[n > 0, None]
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (x @ at.T - 0.5 * (at * at).sum(axis=1)).argmax(axis=1) if len(at) else np.zeros(len(x), dtype=np.int64)


@dataclass
class Quantiser:
    """Centroids of both halves, the spread of residuals around each, and where each cell's entries are."""

    dims: int
    halves: tuple[np.ndarray, np.ndarray]
    spread: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray  # entries of cell i * len(second) + j
    lane: np.ndarray  # first lane of each cell
    cuts: np.ndarray  # lanes of each cell
    reach: float = 0.0

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.dims // 2], x[:, self.dims // 2 :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, and the squared residuals of its halves."""
        a, b = (nearest(h, c) for h, c in zip(self.split(x), self.halves, strict=True))
        r = [((h - c[n]) ** 2).sum(axis=1) for h, c, n in zip(self.split(x), self.halves, (a, b), strict=True)]
        return a * len(self.halves[1]) + b, r[0], r[1]

    def closeness(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The negated distances of every query to the centroids of each half."""
        return tuple(h @ c.T + self.reach * np.linalg.norm(h, axis=1)[:, None] * s for h, c, s in zip(self.split(queries), self.halves, self.spread, strict=True))

    def nearest_pairs(self, one: np.ndarray, two: np.ndarray, entries: int) -> float:
        """The closeness of the pair at which the cells, closest pairs first, hold so many entries; minus infinity if all hold fewer."""
        first, second = np.argsort(-one), np.argsort(-two)
        heap, held = [(-(one[first[0]] + two[second[0]]), 0, 0)], 0
        while heap:
            far, a, b = heapq.heappop(heap)
            held += self.sizes[first[a] * len(two) + second[b]]
            if held >= entries:
                return -far
            if b + 1 < len(two):
                heapq.heappush(heap, (-(one[first[a]] + two[second[b + 1]]), a, b + 1))
            if b == 0 and a + 1 < len(one):
                heapq.heappush(heap, (-(one[first[a + 1]] + two[second[0]]), a + 1, 0))
        return -np.inf


@dataclass
class MultiIndex:
    """``blocks(lane, cells, vectors, owners, ids)`` on shared storage, and its quantiser (None: no entries)."""

    blocks: DataFrame
    quantiser: Quantiser | None
    entries: int


def collapsed(vectors: DataFrame, id_col: str, vector_col: str, dims: int, most: int) -> DataFrame:
    """(v, ids): distinct vectors, each with its ``most`` smallest ids; thinned in each batch and task before it is shuffled."""
    wide = dict(vectors.dtypes)[vector_col] == "array<float>"

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), dims).astype("<f4" if wide else "<f8")
            v, ids = x.view(f"V{x.itemsize * dims}").ravel(), batch.column(0).to_numpy()
            _, group = np.unique(v, return_inverse=True)
            order = np.lexsort((ids, group))
            g, i = group[order], ids[order]
            fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])[: len(g)]
            order, g = order[fresh], g[fresh]
            place = np.arange(len(g)) - np.searchsorted(g, g)
            order = order[place < most]
            yield pa.record_batch([pa.array(ids[order]), pa.array([b.tobytes() for b in x[order]], pa.binary())], names=["id", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & proper(F.col("v")) & (F.size("v") == dims))
    some = rows.mapInArrow(thin, "id long, v binary")
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    return some.withColumn("place", place).filter(F.col("place") <= most).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # ``most`` ids a vector


def common_length(vectors: DataFrame, vector_col: str) -> int:
    """The length that most vectors that take part have (ties: the shorter); 0 if there are none."""
    best = vectors.filter(proper(F.col(vector_col))).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return best.n if best else 0


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", config: MultiIndexConfig = MultiIndexConfig()) -> MultiIndex:
    """Index every row that takes part; the centroids come from ``fit_rows`` distinct vectors of the smallest hashes."""
    spark = vectors.sparkSession
    dims = common_length(vectors, vector_col)
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    entries = materialise(collapsed(vectors, id_col, vector_col, max(dims, 1), config.k + 1), "entries")
    total = entries.count()
    empty = spark.createDataFrame([], "lane int, cells binary, vectors binary, owners binary, ids binary")
    if not total:
        return MultiIndex(empty, None, 0)
    span = 1 << 30
    some = entries.filter(F.pmod(F.xxhash64("v"), F.lit(span)) < int(span * min(1.0, 1.2 * config.fit_rows / total))) if total > config.fit_rows else entries
    sample = some.select("v").orderBy(F.xxhash64("v"), "v").limit(config.fit_rows).toArrow().column("v")  # ``fit_rows`` vectors
    x = np.stack([np.frombuffer(v.as_py(), dtype=kind) for v in sample]).astype(np.float64)
    number = max(1, min(config.most, round((total / config.entries) ** 0.5)))
    half = dims // 2
    parts = tuple(centroids(h, number, config.rounds, config.seed) for h in (x[:, :half], x[:, half:]))
    none = np.zeros(0)
    q = Quantiser(dims, parts, (none, none), none, none, none)
    sent = spark.sparkContext.broadcast(q)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind).reshape(-1, dims).astype(np.float64)
                cell, r1, r2 = sent.value.cells(rows)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(r1), pa.array(r2)], names=["v", "ids", "cell", "r1", "r2"])

    placed = entries.mapInArrow(assign, "v binary, ids array<long>, cell int, r1 double, r2 double")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")).orderBy("cell").toPandas()  # a row a cell: ``most`` squared
    wide = len(parts[1])
    q.sizes = np.zeros(len(parts[0]) * wide, dtype=np.int64)
    q.sizes[stats["cell"]] = stats["n"]
    before = np.cumsum(q.sizes) - q.sizes
    block = min(config.block, max(512, total // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    q.lane, q.cuts = (before // block).astype(np.int32), np.maximum(1, -(-q.sizes // block)).astype(np.int32)

    def spread(of: np.ndarray, r: str, n: int, width: int) -> np.ndarray:
        every = stats[r].sum() / total
        return np.sqrt((np.bincount(of, stats[r], minlength=n) + 8 * every) / (np.bincount(of, stats["n"], minlength=n) + 8) / max(1, width))

    q.spread = spread(stats["cell"] // wide, "r1", len(parts[0]), half), spread(stats["cell"] % wide, "r2", wide, dims - half)
    q.reach = config.reach[0] + config.reach[1] * max(0.0, NormalDist().inv_cdf(max(0.5, 1 - config.k / (total + 1))))
    sent = spark.sparkContext.broadcast(q)

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, salt = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            lane = sent.value.lane[cell] + salt % sent.value.cuts[cell]
            yield pa.record_batch([pa.array(lane.astype(np.int32)), batch.column(2), batch.column(0), batch.column(1)], names=["lane", "cell", "v", "ids"])

    dealt = placed.select("v", "ids", "cell", F.xxhash64("v").bitwiseAND((1 << 31) - 1).alias("salt")).mapInArrow(lanes, "lane int, cell int, v binary, ids array<long>")
    dealt = dealt.repartition("lane").sortWithinPartitions("lane", "cell", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("ids").combine_chunks()
            values = [t.column("cell").to_numpy().astype("<i4").tobytes(), b"".join(t.column("v").to_pylist()), np.diff(ids.offsets.to_numpy()).astype("<i4").tobytes(), ids.flatten().to_numpy().astype("<i8").tobytes()]
            return pa.record_batch([t.column("lane").combine_chunks()[:1], *(pa.array([v], pa.binary()) for v in values)], names=["lane", "cells", "vectors", "owners", "ids"])

        for batch in batches:
            lane = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(lane)) + 1).tolist(), len(lane)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    if held and held[0].column(0)[0].as_py() != lane[lo]:
                        yield block()
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield block()

    return MultiIndex(materialise(dealt.mapInArrow(pack, empty.schema), "blocks"), q, total)


def _visit(index: MultiIndex, asked: DataFrame, kind: str, config: MultiIndexConfig) -> DataFrame:
    """(query_id, vec_id, score): for each of ``asked(id, v, least)`` the best of each lane.

    Visited are the closest cells until they hold ``first`` times k entries, and all that allow a score of ``least``
    (if it is not null), which the scores have to reach.
    """
    spark, q = index.blocks.sparkSession, index.quantiser
    sent = spark.sparkContext.broadcast(q)
    lanes = int((q.lane + q.cuts).max())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, config.queries):
                some = batch.slice(a, config.queries)
                x, ids = rows_of(some.column(1), q.dims), some.column(0).to_numpy()
                least = some.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                one, two = q.closeness(x)
                cut = np.array([q.nearest_pairs(one[r], two[r], config.first * config.k) for r in range(len(ids))])
                cut = np.where(np.isnan(least), cut, np.minimum(cut, least))
                least = np.where(np.isnan(least), -np.inf, least)
                goes = np.zeros((len(ids), lanes), dtype=bool)
                for r in range(len(ids)):
                    cells = np.flatnonzero(((one[r][:, None] + two[r][None, :]) >= cut[r]).ravel() & (q.sizes > 0))
                    goes[r, q.lane[cells]] = True
                    for c in cells[q.cuts[cells] > 1]:
                        goes[r, q.lane[c] : q.lane[c] + q.cuts[c]] = True
                for lane in np.flatnonzero(goes.any(axis=0)):
                    rows = goes[:, lane]
                    yield pa.record_batch([pa.array([lane], pa.int32()), *(pa.array([v[rows].tobytes()], pa.binary()) for v in (ids, x, cut, least))], names=["lane", "q_ids", "q", "cut", "least"])

    packs = asked.repartition(max(1, -(-asked.count() // config.queries))).mapInArrow(route, "lane int, q_ids binary, q binary, cut binary, least binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, name, block = sent.value, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                lane, cells, vectors, owners, ids, q_ids, asks, cut, least = (batch.column(c)[r].as_py() for c in range(9))
                if lane != name:
                    x = np.frombuffer(vectors, dtype=kind).reshape(-1, model.dims).astype(np.float64)
                    n = np.frombuffer(owners, dtype="<i4").astype(np.int64)
                    name, block = lane, (np.frombuffer(cells, dtype="<i4"), x, np.concatenate([[0], np.cumsum(n)]), np.frombuffer(ids, dtype="<i8"))
                asks = np.frombuffer(asks).reshape(-1, model.dims)
                found = _best(model, *block, np.frombuffer(q_ids, dtype=np.int64), asks, np.frombuffer(cut), np.frombuffer(least), config.k)
                yield pa.record_batch([*map(pa.array, found)], names=["query_id", "vec_id", "score"])

    pairs = index.blocks.join(packs.hint("merge"), "lane").select("lane", "cells", "vectors", "owners", "ids", "q_ids", "q", "cut", "least")
    return pairs.mapInArrow(score, "query_id long, vec_id long, score double")


def _best(q: Quantiser, cells: np.ndarray, x: np.ndarray, first: np.ndarray, ids: np.ndarray, own: np.ndarray, asks: np.ndarray, cut: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best ids in the visited cells of a block."""
    one, two = q.closeness(asks)
    slack = 1e-9 * (1 + np.linalg.norm(asks, axis=1) * np.linalg.norm(x, axis=1).max(initial=0))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
    who, what, near = [], [], []
    wide = len(q.halves[1])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = np.flatnonzero(one[:, cells[lo] // wide] + two[:, cells[lo] % wide] >= cut)
        if len(rows):
            s = asks[rows] @ x[lo:hi].T
            a, b = np.nonzero(s >= (least - slack)[rows, None])
            who.append(rows[a])
            what.append(b + lo)
            near.append(s[a, b])
    if not who:
        return own[:0], own[:0], np.zeros(0)
    who, what, near = map(np.concatenate, (who, what, near))
    # The k + 1 best entries of each query hold its k best ids; the slack keeps those that rounding moved.
    order = np.lexsort((-near, who))
    who, what, near = who[order], what[order], near[order]
    start = np.searchsorted(who, who)
    last = np.minimum(start + k, np.searchsorted(who, who, side="right") - 1)
    keep = near >= near[last] - slack[who]
    who, what = who[keep], what[keep]
    exact = np.zeros(len(who))
    for d in range(q.dims):
        exact += x[what, d] * asks[who, d]
    size = np.diff(first)[what]
    at = np.repeat(np.arange(len(who)), size)
    found = ids[first[what][at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)]
    other = found != own[who[at]]
    at, found = at[other], found[other]
    order = np.lexsort((found, -exact[at], who[at]))
    at, found = at[order], found[order]
    place = np.arange(len(at)) - np.searchsorted(who[at], who[at])
    at, found = at[place < k], found[place < k]
    return own[who[at]], found, exact[at]


def search(index: MultiIndex, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", config: MultiIndexConfig = MultiIndexConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, nearest first, ties to the smaller id.

    The score is the exact inner product, added up in the order of the components, in doubles. Null
    and zero vectors, those with a null or non-finite component or a null id, and those of another length
    than most of the index take no part. As a query an id asks once, with the least of its vectors; a query never
    finds its own id. Rows that repeat both id and vector are one candidate, an id with several vectors one for
    each. With k candidates or fewer all are found. Empty tables give an empty result; other columns are ignored.
    """
    spark = index.blocks.sparkSession
    if index.quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f4" if len(index.blocks.head(1)) and _narrow(index) else "<f8"
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & proper(F.col("v")) & (F.size("v") == index.quantiser.dims))
    asked = materialise(rows.groupBy("id").agg(F.min("v").alias("v")), "asked")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.k)
    bound = top(_visit(index, asked.withColumn("least", F.lit(None).cast("double")), kind, config)).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == config.k, F.min("score")).otherwise(float("-inf")).alias("least"))
    bounded = materialise(asked.join(bound, asked.id == bound.query_id, "left").select("id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least")), "bounded")
    return top(_visit(index, bounded, kind, config)).select("query_id", "rank", "vec_id", "score")


def _narrow(index: MultiIndex) -> bool:
    """Whether the stored vectors are floats of 32 bits."""
    one = index.blocks.select(F.octet_length("vectors").alias("bytes"), (F.octet_length("cells") / 4).cast("long").alias("rows")).first()
    return one.bytes == 4 * one.rows * index.quantiser.dims

"""Exact n-gram Jaccard join: pivots, Voronoi regions, triangle windows, recursion.

The Jaccard distance ``d = 1 - |x & y| / |x | y|`` is a metric, and two documents link when
``d <= t``. The join works in these steps; none of them emits all pairs of a group.

1. Equal shingle sets become one class (its smallest id stands for it).
2. A pre-filter gives the first cells. Shingles get one total order, those seen often last. A link
   implies a shared shingle among the first ``n - ceil((1 - t) n) + 1`` of both documents, at
   positions that leave room for the overlap (prefix and position filters; they lose nothing for
   any order). Every shared prefix shingle elects a pivot, the document where it stands earliest,
   and the cell of a pivot holds all documents that share one of its shingles, so that both ends of
   every link meet in some cell.
3. Each document's distance to its pivots is bounded by small bitmaps and, where it may be within
   ``t``, computed exactly. The ball ``d <= t`` links to the pivot at once. Only members outside
   the pivot's component ask for more links.
4. A cell with open members and more members than a block is divided again: some of its members are
   drawn as pivots, each member gets its exact distances to them, and belongs to the Voronoi region
   of the nearest, ``p``. It is replicated to the region of every other pivot ``r`` with
   ``d(x, r) <= d(x, p) + 2 t``. So no link is lost: where ``d(x, y) <= t`` and ``r`` is nearest to
   ``y``, ``d(x, r) <= t + d(y, r) <= t + d(y, p) <= 2 t + d(x, p)``. Regions that are still larger
   than a block are divided in the same way, as long as that leaves fewer pairs to look at (documents
   that are all far from each other cannot be separated by any pivots).
5. What is left of a region is compared in blocks of bounded size: askers with members, inside the
   triangle window ``|d(x, p) - d(y, p)| <= t`` around the region's pivot; of that, the pairs whose
   bitmaps allow a link are verified exactly.
6. Links are closed to components.

The pre-filter stands before the first division because unrelated texts are all at distance 1: with
pivots drawn from the whole table, every window of ``2 t`` would hold nearly all of it.
Nothing is approximate but the 64-bit hash of a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import textcore
from almanack.llm.graph import components
from almanack.llm.storage import materialise


@dataclass(frozen=True)
class JaccardConfig:
    """``hot_shingles``: size bound of the broadcast table of frequent shingles (it only orders
    them). ``bloom_bits``: size bound of the broadcast filter of documents that some step needs, which
    has 8 to 16 bits for each (false positives only cost time; beyond the bound a semi-join takes
    its place). ``query_block``, ``member_block``: rows that one block compares; ``pivots``: expected
    number of pivots that divide a region; ``levels``: most divisions of divisions."""

    width: int = 5
    percent: int = 80
    hot_shingles: int = 1 << 17
    bloom_bits: int = 1 << 27
    query_block: int = 64
    member_block: int = 256
    pivots: int = 8
    levels: int = 4


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _ids(batch: pa.RecordBatch, lo: int, hi: int) -> pa.Array:
    return batch.column(0).slice(lo, hi - lo)


def _scan(width: int):
    """Per document its set's size and 128-bit fingerprint; and shingles met in several documents of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
        for batch in batches:
            for lo, hi, data, offs in textcore.slices(batch.column(1)):
                word, _, _, first = textcore.words(data, offs)
                h, at = textcore.shingles(word, first, width)
                sets = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                k1 = np.array([np.add.reduce(textcore.mix(s)) for s in sets], dtype=np.uint64)
                k2 = np.array([np.bitwise_xor.reduce(textcore.mix(s * np.uint64(0x9FB21C651E98DF25))) for s in sets], dtype=np.uint64)
                yield pa.record_batch([pa.array(np.zeros(hi - lo, dtype=np.int32)), _ids(batch, lo, hi), pa.array(n), pa.array(_signed(k1)), pa.array(_signed(k2))], schema=schema)
                if len(sets) > 1:
                    every = np.sort(np.concatenate(sets))
                    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
                    count = np.diff(np.append(starts, len(every)))
                    often = count > 1
                    if often.any():
                        m = int(often.sum())
                        yield pa.record_batch([pa.array(np.ones(m, dtype=np.int32)), pa.nulls(m, pa.int64()), pa.array(count[often].astype(np.int64)), pa.array(_signed(every[starts[often]])), pa.array(np.zeros(m, dtype=np.int64))], schema=schema)

    return run


def _prefixes(width: int, percent: int, hot):
    """Per document its set's size and its first shingles in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = hot.value
        seen = np.zeros(1 << 22, dtype=bool)
        seen[keys >> np.uint64(42)] = True
        for batch in batches:
            for lo, hi, data, offs in textcore.slices(batch.column(1)):
                word, _, _, first = textcore.words(data, offs)
                h, at = textcore.shingles(word, first, width)
                n, pre = np.zeros(hi - lo, dtype=np.int64), []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    s = np.unique(h[a:b])
                    n[i] = k = len(s)
                    take = k - -(-k * percent // 100) + 1 if k else 0
                    maybe = np.flatnonzero(seen[s >> np.uint64(42)])
                    if len(maybe) and len(keys):
                        where = np.minimum(np.searchsorted(keys, s[maybe]), len(keys) - 1)
                        hit = keys[where] == s[maybe]
                        rank = np.zeros(k, dtype=np.int64)
                        rank[maybe[hit]] = counts[where[hit]]
                        s = s[np.lexsort((s, rank))]
                    pre.append(s[:take])
                cut = np.concatenate([[0], np.cumsum([len(p) for p in pre])]).astype(np.int32)
                flat = _signed(np.concatenate(pre)) if pre else np.zeros(0, dtype=np.int64)
                yield pa.record_batch([_ids(batch, lo, hi), pa.array(n), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["id", "n", "pre"])

    return run


def _chosen(width: int, bloom, encode, names: list[str]):
    """``encode(sorted sets)`` for the documents that the filter lets through (all without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bloom.value if bloom else None
        for batch in batches:
            keep = ~np.asarray(batch.column(0).is_null())
            if wanted is not None:
                spot = _spot(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), len(wanted) << 6)
                keep &= (wanted[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
            part = batch.filter(pa.array(keep))
            for lo, hi, data, offs in textcore.slices(part.column(1)):
                word, _, _, first = textcore.words(data, offs)
                h, at = textcore.shingles(word, first, width)
                columns = encode([np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
                yield pa.record_batch([_ids(part, lo, hi), *columns], names=["id", *names])

    return run


def _sets_of(base: DataFrame, ids: DataFrame, encode, fields: str, config: JaccardConfig) -> DataFrame:
    """``encode`` of the sets of the documents in ``ids(id)``, and of few others, each once."""
    spark, bloom = base.sparkSession, None
    ids = materialise(ids.distinct(), "wanted")
    bits = max(1 << 12, 1 << (8 * ids.count()).bit_length())
    if bits <= config.bloom_bits:
        bloom = spark.sparkContext.broadcast(_bloom(ids, bits))
    else:
        base = base.join(ids, "id", "left_semi")
    names = [f.split()[0] for f in fields.split(", ")]
    return base.mapInArrow(_chosen(config.width, bloom, encode, names), f"id long, {fields}").dropDuplicates(["id", *names])


def _as_sets(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([s.tobytes() for s in sets], type=pa.binary())]


def _as_bits(sets: list[np.ndarray]) -> list[pa.Array]:
    """Sizes, and bitmaps of 4 to 8 bits an item: what one lacks of the other's bits, its set lacks too."""
    out = []
    for s in sets:
        m = 1 << max(6, int(4 * len(s) - 1).bit_length()) if len(s) else 64
        flags = np.zeros(m, dtype=np.uint8)
        flags[(s & np.uint64(m - 1)).astype(np.int64)] = 1
        out.append(np.packbits(flags, bitorder="little").tobytes())
    return [pa.array([len(s) for s in sets], type=pa.int64()), pa.array(out, type=pa.binary())]


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with half the size, until ``words`` wide."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _most(n: np.ndarray, bits: np.ndarray, m: int, other: np.ndarray) -> np.ndarray:
    """An upper bound on the overlap of each set with one other, from their bitmaps."""
    width = min(bits.shape[-1], other.shape[-1])
    x, y = _fold(bits, width), _fold(other, width)
    both = np.bitwise_count(x & y).sum(axis=-1, dtype=np.int64)
    lack_x = np.bitwise_count(x).sum(axis=-1, dtype=np.int64) - both
    lack_y = int(np.bitwise_count(y).sum(dtype=np.int64)) - both
    return np.minimum(n - lack_x, m - lack_y)


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most that the two sets of a row can share."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        most = np.zeros(batch.num_rows, dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            most[i] = _most(n[i : i + 1], a[None, :], m[i], b)[0]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), pa.array(m), pa.array(most)], names=["id", "pivot", "n", "pivot_n", "most"])


def _spot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (textcore.mix(ids.view(np.uint64)) >> np.uint64(1)).view(np.int64) & (bits - 1)


def _bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits over ids; what reaches the driver is at most ``bits / 64`` words."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = np.unique(_spot(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits))
            cell, start = np.unique(spot >> 6, return_index=True)
            word = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (spot & 63).astype(np.uint64)), start) if len(spot) else np.zeros(0, dtype=np.uint64)
            yield pa.record_batch([pa.array(cell), pa.array(_signed(word))], names=["cell", "word"])

    rows = ids.mapInArrow(spots, "cell long, word long").groupBy("cell").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(max(1, bits >> 6), dtype=np.uint64)
    out[rows.column("cell").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return out


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sizes and overlap of the two sets of a row."""
    for batch in batches:
        out = np.zeros((3, batch.num_rows), dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            out[:, i] = len(a), len(b), _common(a, b)
        yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, out)], names=["a", "b", "n", "m", "overlap"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _block(percent: int):
    """Pairs of one block of queries and one block of members of a region that may link."""
    window = 1 - percent / 100 + 1e-9

    def run(table: pa.Table) -> pa.Table:
        ids, own, n = (table[k].to_numpy() for k in ("id", "own", "n"))
        lo, hi = table["far"].to_numpy(), table["far_most"].to_numpy()
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        bits = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["bits"]]
        wide = np.array([len(x) for x in bits], dtype=np.int64)
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for w in np.unique(wide[~asks]):
            some = np.flatnonzero(~asks & (wide == w))
            stack = np.stack([bits[i] for i in some])
            for q in np.flatnonzero(asks & (wide * 4 >= w) & (wide <= 4 * w)):
                fits = (lo[q] - hi[some] <= window) & (lo[some] - hi[q] <= window) & (own[some] != own[q])
                fits &= 100 * np.minimum(n[some], n[q]) >= percent * np.maximum(n[some], n[q])
                if fits.any():
                    at = some[fits]
                    most = _most(n[at], stack[fits], n[q], bits[q])
                    at = at[100 * most >= percent * (n[at] + n[q] - most)]
                    a.append(np.minimum(ids[at], ids[q]))
                    b.append(np.maximum(ids[at], ids[q]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _frequent(counts: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``bound`` shingles with the highest counts: whole quarter octaves of counts, from the top."""
    total = counts.groupBy("k1").agg(F.sum("n").alias("c")).filter("c >= 4").withColumn("band", F.floor(4 * F.log2("c")).cast("int"))
    total = materialise(total, "often")
    left, lowest = bound, None
    for r in total.groupBy("band").count().orderBy(F.desc("band")).collect():  # at most 256 bands
        left -= r["count"]
        if left < 0:
            break
        lowest = r["band"]
    if lowest is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = total.filter(F.col("band") >= lowest).select("k1", "c").toArrow()
    keys, count = rows.column("k1").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], count[order]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest linked id, itself included).

    Null, empty and blank texts have size 0 and are alone. A null id has a null component and
    takes part in nothing. Rows that repeat an id are one document: what links to any of their texts
    is in its component, and ``n_shingles`` is that of each row. Texts of any length are used whole.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark, p = docs.sparkSession, config.percent
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialise(base.mapInArrow(_scan(config.width), "kind int, id long, n long, k1 long, k2 long"), "sets")
    hot = spark.sparkContext.broadcast(_frequent(scanned.filter("kind = 1"), config.hot_shingles))
    each = scanned.filter("kind = 0").drop("kind")
    real = each.filter("n > 0 and id is not null")
    # Aggregates are written before they are joined: a plain exchange on both sides lets adaptive execution split a hot key.
    classes = materialise(real.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes")

    reps = classes.select(F.col("rep").alias("id"))
    pre = base.mapInArrow(_prefixes(config.width, p, hot), "id long, n long, pre array<long>").filter("n > 0").join(reps, "id", "left_semi")
    pre = materialise(pre, "prefixes")
    posts = pre.select("id", F.col("n").cast("int").alias("n"), F.posexplode("pre").alias("pos", "h"))
    early = F.expr(f"pos <= n - ceil({2 * p} * n / {100 + p})")
    groups = posts.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(early, F.col("n"))).alias("low")).filter("c > 1 and low is not null")
    groups = materialise(groups.select("h", "low"), "groups")
    shared = posts.join(groups, "h").filter(early | F.expr(f"cast(n - pos as long) * {100 + p} >= cast({p} as long) * (low + n)"))
    shared = materialise(shared.select("h", "id", "n", "pos"), "shared")
    lead = shared.groupBy("h").agg(F.min(F.struct("pos", "n", "id")).alias("l"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", F.col("l.id").alias("pivot"))
    cells = materialise(shared.join(materialise(lead, "lead"), "h").filter("id <> pivot").select("id", "pivot").distinct(), "cells")

    bits = materialise(_sets_of(base, cells.select("id").union(cells.select("pivot")), _as_bits, "n long, bits binary", config), "bits")
    near = cells.join(bits, "id").join(bits.toDF("pivot", "pivot_n", "pivot_bits"), "pivot")
    near = near.select("id", "pivot", "n", "bits", "pivot_n", "pivot_bits").mapInArrow(_bounds, "id long, pivot long, n long, pivot_n long, most long")
    near = materialise(near, "near")
    first = _verify(base, near.filter(f"100 * most >= {p} * (n + pivot_n - most)").select(F.col("id").alias("a"), F.col("pivot").alias("b")), config)
    done = materialise(components(first.filter("linked")), "done")

    members = _members(near, first, done)
    more = _join_regions(base, _divide(base, members, config), bits, config)
    again = real.groupBy("id").agg(F.min(F.struct("k1", "k2", "n")).alias("x"), F.max(F.struct("k1", "k2", "n")).alias("y")).filter("x <> y").select("id")
    texts = materialise(real.join(again, "id").join(classes, ["k1", "k2", "n"]).select("id", "rep"), "repeated")
    same = texts.join(texts.groupBy("id").agg(F.min("rep").alias("low")), "id").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    closed = components(done.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(same))
    named = real.join(classes, ["k1", "k2", "n"]).select("id", "n", "rep").join(closed.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = each.filter("n = 0 or id is null").select("id", "n", F.when(F.col("id").isNotNull(), F.col("id")).alias("component_id"))
    return named.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _verify(base: DataFrame, pairs: DataFrame, config: JaccardConfig) -> DataFrame:
    """(a, b, far, linked): the exact distance of each pair. Only sets that some pair names are moved."""
    sets = _sets_of(base, pairs.select("a").union(pairs.select("b")).toDF("id"), _as_sets, "items binary", config)
    both = pairs.join(sets.toDF("a", "a_items"), "a").join(sets.toDF("b", "b_items"), "b").select("a", "b", "a_items", "b_items")
    out = both.mapInArrow(_overlaps, "a long, b long, n long, m long, overlap long")
    out = out.withColumn("linked", F.expr(f"100 * overlap >= {config.percent} * (n + m - overlap)"))
    return materialise(out.select("a", "b", F.expr("1 - overlap / (n + m - overlap)").alias("far"), "linked"), "verified")


def _members(near: DataFrame, first: DataFrame, done: DataFrame) -> DataFrame:
    """(region, id, far, far_most, own, asks): the members of the first cells, their distance's bounds and component."""
    own = done.select(F.col("node").alias("id"), F.col("component").alias("own"))
    of = near.select("id", "pivot", F.expr("1 - most / (n + pivot_n - most)").alias("least"))
    of = of.join(first.select(F.col("a").alias("id"), F.col("b").alias("pivot"), F.col("far").alias("exact")), ["id", "pivot"], "left").join(own, "id", "left")
    of = of.join(own.select(F.col("id").alias("pivot"), F.col("own").alias("pivot_own")), "pivot", "left")
    of = of.select(F.col("pivot").cast("string").alias("region"), "id", F.coalesce("exact", "least").alias("far"), F.coalesce("exact", F.lit(1.0)).alias("far_most"), F.coalesce("own", "id").alias("own"), F.expr("coalesce(own, id) <> coalesce(pivot_own, pivot)").alias("asks"))
    return materialise(of, "members")


def _divide(base: DataFrame, members: DataFrame, config: JaccardConfig) -> DataFrame:
    """The members of all regions that cannot be, or need not be, divided further, with (qb, mb): their blocks."""
    ready = None
    for level in range(config.levels + 1):
        size = members.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.count_if("asks").alias("q")).filter("q > 0 and m > 1")
        members = materialise(members.join(materialise(size, "sizes"), "region"), "open")
        small = members.filter(F.col("m") <= config.member_block)
        large = members.filter(F.col("m") > config.member_block)
        if level == config.levels or large.isEmpty():
            small = members
        else:
            parts = _voronoi(base, large, level, config)
            # A region is divided where that leaves clearly fewer pairs to compare.
            work = parts.groupBy("parent", "region").agg((F.count_if("asks") * F.count(F.lit(1))).alias("w")).groupBy("parent").agg(F.sum("w").alias("w"))
            gain = work.join(large.select(F.col("region").alias("parent"), "m", "q").distinct(), "parent").filter(F.col("w") < 0.7 * F.col("m") * F.col("q")).select("parent")
            gain = materialise(gain, "divided")
            small = small.union(large.join(gain.withColumnRenamed("parent", "region"), "region", "left_anti").select(small.columns))
        ready = small if ready is None else ready.union(small)
        if small is members:
            break
        members = parts.join(gain, "parent", "left_semi").select("region", "id", "far", "far_most", "own", "asks")
    return ready.select("region", "id", "far", "far_most", "own", "asks", F.ceil(F.col("q") / config.query_block).cast("int").alias("qb"), F.ceil(F.col("m") / config.member_block).cast("int").alias("mb"))


def _voronoi(base: DataFrame, large: DataFrame, level: int, config: JaccardConfig) -> DataFrame:
    """(parent, region, ...): the members of each region in those of its own pivots that they are near to.

    Pivots are drawn by a hash of the id, about ``pivots`` a region, whatever its size.
    """
    large = materialise(large.join(_sets_of(base, large.select("id"), _as_sets, "items binary", config), "id"), "divide")
    drawn = large.filter(F.pmod(F.xxhash64("id", "region", F.lit(level)), F.col("m")) < config.pivots).dropDuplicates(["region", "id"])
    drawn = materialise(drawn.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("id", "items"))).alias("pivots")), "pivots")
    window = 2 * (1 - config.percent / 100) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, name, far = [], [], []
            for i, (items, region, pivots) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                x, d = np.frombuffer(items.as_buffer(), dtype=np.uint64), []
                for one in pivots.values:
                    y = np.frombuffer(one["items"].as_buffer(), dtype=np.uint64)
                    both = _common(x, y)
                    d.append(1 - both / (len(x) + len(y) - both))
                for one, distance in zip(pivots.values, d, strict=True):
                    if distance <= min(d) + window:
                        row.append(i)
                        name.append(f"{region}/{one['id'].as_py()}")
                        far.append(distance)
            kept = batch.take(pa.array(row, pa.int64()))
            yield pa.record_batch([kept.column(1), pa.array(name, pa.string()), kept.column(3), pa.array(far, pa.float64()), pa.array(far, pa.float64()), kept.column(4), kept.column(5)], names=["parent", "region", "id", "far", "far_most", "own", "asks"])

    rows = large.join(drawn, "region").select("items", "region", "pivots", "id", "own", "asks")
    return materialise(rows.mapInArrow(run, "parent string, region string, id long, far double, far_most double, own long, asks boolean"), "voronoi")


def _join_regions(base: DataFrame, part: DataFrame, bits: DataFrame, config: JaccardConfig) -> DataFrame:
    """Links of the askers of every region with its other members, block by block."""
    keep = ["region", "id", "far", "far_most", "own"]
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    ask = part.filter("asks").select(*keep, F.lit(True).alias("asks"), spot("qb").alias("x"), F.explode(F.expr("sequence(0, mb - 1)")).alias("y"))
    answer = part.select(*keep, F.lit(False).alias("asks"), F.explode(F.expr("sequence(0, qb - 1)")).alias("x"), spot("mb").alias("y"))
    rows = ask.union(answer).join(bits, "id")
    pairs = rows.groupBy("region", "x", "y").applyInArrow(_block(config.percent), "a long, b long").filter("a <> b").distinct()
    return _verify(base, materialise(pairs, "pairs"), config).filter("linked").select("a", "b")

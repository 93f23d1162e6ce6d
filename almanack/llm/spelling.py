"""Spelling variants: words one edit apart, found in tries of letter-group counts.

Letters fall into ``groups``. A word's vector counts its letters by group, and a trie arranges the words
by successive counts. One inserted, deleted or replaced letter makes at most one count greater by one
(the surplus) and at most one less by one (the deficit), so a depth-first search that may spend one of
each reaches every word within one edit; the words of the leaves that it reaches are verified.

The upper levels of the trie are dealt over tasks: a word belongs to the part under its own first counts,
and asks in each part that its budget can reach. Below, each task holds the trie of one part at a time,
of at most ``block`` words (a larger part is divided, and asked in each division), and all questions
walk it together as arrays. Of two words the one in the smaller part asks, so no pair is found twice.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import textcore
from almanack.llm.storage import drop, materialise


@dataclass(frozen=True)
class SpellingConfig:
    """Words of ``letters`` code points at least that occur ``least`` times; a form is used ``ratio`` times as
    often as its variant. ``noise``: where it divides the CRC-32 of ``<id>:<word>``, the word loses a letter (0: never)."""

    letters: int = 6
    least: int = 5
    ratio: int = 5
    noise: int = 0
    groups: int = 10
    block: int = 20_000
    pairs: int = 1 << 17


def words_of(data: np.ndarray, offs: np.ndarray, ids: list[str], config: SpellingConfig) -> pa.Array:
    """The words of a slice of texts: runs of ``A-Za-z`` and U+00C0 to U+00FF, A-Z lower-cased, long enough."""
    low, lead = textcore.LOWER[data], data == 0xC3
    tail = np.concatenate([[False], lead[:-1]])[: len(data)]
    starts, ends = textcore.runs(((low >= 97) & (low <= 122)) | lead | tail, offs)
    tails = np.concatenate([[0], np.cumsum(tail)])
    chars = ends - starts - (tails[ends] - tails[starts])
    keep = chars >= config.letters
    starts, ends, chars = starts[keep], ends[keep], chars[keep]
    lost, length = np.zeros(0, dtype=np.int64), ends - starts
    if config.noise and len(starts):
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
        h = textcore.crc32(low, starts, ends, before[np.searchsorted(offs, starts, side="right") - 1]).astype(np.int64)
        hit = np.flatnonzero(h % config.noise == 0)
        letters = np.flatnonzero(~tail)
        lost = letters[np.searchsorted(letters, starts[hit]) + h[hit] % chars[hit]]
        length[hit] -= 1 + lead[lost]
        chars[hit] -= 1
        keep = chars >= config.letters
        starts, ends, length = starts[keep], ends[keep], length[keep]
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    inside[lost] = False
    inside[lost[lead[lost]] + 1] = False
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(low[inside]))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n) of words that occur ``least`` times in all texts; counted in each task before they are shuffled."""
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for lo, hi, data, offs in textcore.slices(batch.column(1)):
                found = pc.value_counts(words_of(data, offs, batch.column(0)[lo:hi].to_pylist(), config))
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                size += len(found)
                if size > 400_000:
                    held = [counted()]
                    size = held[0].num_rows
                    if size > 200_000:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from counted().to_batches()

    each = base.mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= config.least)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a code point (they are below U+0100), and offsets."""
    offs = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]] if words.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    lead = data == 0xC3
    high = np.concatenate([[False], lead[:-1]])[: len(data)]
    before = np.concatenate([[0], np.cumsum(lead)])
    offs = offs - offs[0]
    return np.where(high, data + 0x40, data)[~lead].astype(np.uint8), offs - before[offs]


def vectors(letters: np.ndarray, offs: np.ndarray, groups: int) -> np.ndarray:
    """Letters by group, one row a word; a letter's group is its code point modulo ``groups``."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    return np.bincount(row * groups + letters % groups, minlength=n * groups).reshape(n, groups)


def reach(levels: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(change of the first counts, surplus left, deficit left) that a word asks with: no change, and all to a greater prefix."""
    out = []
    for step in itertools.product((0, 1, -1), repeat=levels):
        if step.count(1) <= 1 and step.count(-1) <= 1 and next((s for s in step if s), 1) > 0:
            out.append((step, 1 - step.count(1), 1 - step.count(-1)))
    return out


class Trie:
    """Words by successive counts; a level holds the sorted keys (parent, count) of its nodes."""

    def __init__(self, counts: np.ndarray) -> None:
        n, self.depth = counts.shape
        self.order = np.lexsort(counts.T[::-1]) if self.depth else np.arange(n)
        v = counts[self.order]
        self.wide = int(counts.max(initial=0)) + 2
        self.keys: list[np.ndarray] = []
        node, new = np.zeros(n, dtype=np.int64), np.zeros(max(0, n - 1), dtype=bool)
        for level in range(self.depth):
            key = node * self.wide + v[:, level]
            new |= v[1:, level] != v[:-1, level]
            first = np.concatenate([[True], new])
            self.keys.append(key[first])
            node = np.cumsum(first) - 1
        self.first = np.append(np.searchsorted(node, np.arange(node[-1] + 1)), n)

    def search(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(questions, leaves) within the budget, depth first, at most ``most`` questions abreast."""
        stack = [(0, np.arange(a, min(a + most, len(counts))), np.zeros(min(most, len(counts) - a), dtype=np.int64), surplus[a : a + most], deficit[a : a + most]) for a in range(0, len(counts), most)]
        while stack:
            level, q, node, more, less = stack.pop()
            if level == self.depth:
                yield q, node
                continue
            keys = self.keys[level]
            for step, may in ((1, more > 0), (-1, less > 0), (0, slice(None))):
                want = counts[q[may], level] + step
                key = np.where((want >= 0) & (want < self.wide), node[may] * self.wide + want, -1)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = keys[at] == key
                if ok.any():
                    stack.append((level + 1, q[may][ok], at[ok], more[may][ok] - (step > 0), less[may][ok] - (step < 0)))


def one_edit(a: tuple[np.ndarray, np.ndarray], i: np.ndarray, b: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Whether words i of ``a`` and j of ``b`` differ by exactly one inserted, deleted or replaced letter."""
    size, other = np.diff(a[1])[i], np.diff(b[1])[j]
    out = np.abs(size - other) <= 1
    pick = np.flatnonzero(out)
    if not len(pick):
        return out
    i, j, size, other = i[pick], j[pick], size[pick], other[pick]
    flip = size > other
    n, more = np.minimum(size, other), np.maximum(size, other)
    both = np.concatenate([a[0], b[0], np.zeros(1, dtype=np.uint8)])
    short = np.where(flip, len(a[0]) + b[1][:-1][j], a[1][:-1][i])
    long_ = np.where(flip, a[1][:-1][i], len(a[0]) + b[1][:-1][j])
    head = np.zeros(len(n), dtype=np.int64)  # letters that agree from the left, then from the right
    live = np.arange(len(n))
    k = 0
    while len(live := live[n[live] > k]):
        live = live[both[short[live] + k] == both[long_[live] + k]]
        head[live] += 1
        k += 1
    tail = np.zeros(len(n), dtype=np.int64)
    live, k = np.arange(len(n)), 0
    while len(live := live[n[live] > k]):
        live = live[both[short[live] + n[live] - 1 - k] == both[long_[live] + more[live] - 1 - k]]
        tail[live] += 1
        k += 1
    out[pick] = np.where(n == more, head + tail == n - 1, head + tail >= n)
    return out


def near_words(words: DataFrame, config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, near, n): each word of ``words(word, n)`` with each word one edit away and its n, both ways round."""
    total = words.count()
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = min(config.block, max(256, total // (2 * parts)))
    levels = min(config.groups, max(2, math.ceil(math.log(max(total, 1) / 4000 + 1, 4))))
    steps = reach(levels)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                some = batch.slice(a, 4096)
                top = vectors(*letters_of(some.column(0)), config.groups)[:, :levels].astype(">i4")
                for ask, change in [(-1, (0,) * levels), *((1 * s + 2 * d + 4 * (not any(c)), c) for c, s, d in steps)]:
                    at = top + np.array(change, dtype=">i4")
                    ok = np.flatnonzero((at >= 0).all(axis=1))
                    key = pa.array([x.tobytes() for x in at[ok].astype(">i4")], pa.binary())
                    rows = some.take(pa.array(ok))
                    yield pa.record_batch([key, pa.array(np.full(len(ok), ask, dtype=np.int32)), rows.column(0), rows.column(1)], names=["part", "ask", "word", "n"])

    rows = words.select("word", "n").mapInArrow(spread, "part binary, ask int, word string, n long")
    large = rows.filter("ask = -1").groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts")).filter("cuts > 1")
    rows = rows.join(large, "part", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")
    rows = rows.withColumn("cut", F.explode(F.when(F.col("ask") < 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1)))).drop("cuts")
    rows = rows.repartition(parts, "part", "cut").sortWithinPartitions("part", "cut", "ask")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, trie, own = None, [], None, None
        for batch in batches:
            names = list(zip(batch.column("part").to_pylist(), batch.column("cut").to_pylist(), strict=True))
            asks = batch.column("ask").to_numpy()
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1] or (asks[k] < 0) != (asks[k - 1] < 0)), len(names)]
            for lo, hi in itertools.pairwise(edges):
                if hi == lo:
                    continue
                if names[lo] != name:
                    name, held, trie = names[lo], [], None
                some = batch.slice(lo, hi - lo)
                if asks[lo] < 0:
                    held.append(some)
                    continue
                if not held:
                    continue  # nobody lives here
                if trie is None:
                    entries = pa.Table.from_batches(held).combine_chunks()
                    entry, entry_n = entries.column("word").combine_chunks(), entries.column("n").to_numpy()
                    own = letters_of(entry)
                    trie = Trie(vectors(*own, config.groups)[:, levels:])
                ask, ask_n, budget = some.column("word"), some.column("n").to_numpy(), asks[lo:hi]
                mine = letters_of(ask)
                for q, leaf in trie.search(vectors(*mine, config.groups)[:, levels:], budget & 1, (budget >> 1) & 1, 4096):
                    size = trie.first[leaf + 1] - trie.first[leaf]
                    ends = np.cumsum(size)
                    for a in range(0, int(ends[-1]), config.pairs):
                        spot = np.arange(a, min(a + config.pairs, int(ends[-1])))
                        k = np.searchsorted(ends, spot, side="right")
                        i, j = q[k], trie.order[trie.first[leaf[k]] + spot - (ends[k] - size[k])]
                        ok = one_edit(mine, i, own, j)
                        i, j = i[ok], j[ok]
                        x, y = ask.take(pa.array(i)), entry.take(pa.array(j))
                        once = ((budget[i] & 4) == 0) | pc.less(x, y).to_numpy(zero_copy_only=False)  # in its own part the smaller word asks
                        if once.any():
                            x, y, once_ = x.filter(pa.array(once)), y.filter(pa.array(once)), once
                            yield pa.record_batch([pa.concat_arrays([x, y]), pa.concat_arrays([y, x]), pa.array(np.concatenate([entry_n[j[once_]], ask_n[i[once_]]]))], names=["word", "near", "n"])

    return rows.mapInArrow(search, "word string, near string, n long")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms followed to the last, in chains of at most ``longest`` steps, by doubling."""
    hops = materialise(forms.select("word", F.col("form").alias("root")), "hops")
    for _ in range(math.ceil(math.log2(max(longest, 1)))):
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "hops")
        drop(hops.sparkSession, hops)
        hops = after
    return hops


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that is ``ratio``
    times the word's n at least; its root is where following forms ends, the word itself if it has none. A null
    text has no words, and a null id counts as an empty one; rows that repeat are read each. Very long
    texts and words are taken whole. Empty tables give an empty result. Other columns are ignored.
    """
    if config.ratio < 2:
        raise ValueError("a form must be used at least twice as often as its variant")
    words = materialise(word_counts(docs, id_col, text_col, config), "words")
    best = near_words(words, config).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("b"))
    fits = -F.col("b.less") >= config.ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", F.when(fits, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("b.less")).alias("form_n"))
    found = materialise(found, "forms")
    most = found.agg(F.max("n")).first()[0] or 1
    ends = roots(found.filter("form is not null"), int(math.log(max(most, 1), config.ratio)) + 1)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words (lower-cased A-Z; letters, digits and all non-ASCII bytes). A
document leaks an item of ``L`` words when some run of its words, of any length, is within
``k = floor(edit_share * L)`` word edits of the item.

* Such a run has at most ``L + k`` words and shares ``L - q + 1 - k q`` q-grams with the item (q-gram
  lemma, ``q`` small enough to make that positive); this loses nothing and leaves few places where it
  may start.
* The item-sized window at each such place (filled up behind the end of the document) and each item
  are embedded by the CGK random walk: read a symbol, write it, advance or stay by a random bit of
  (step, symbol). Edit distance ``k`` becomes Hamming distance O(k^2) with good probability. Several
  walks, each with tables that sample ``sample`` positions, are compared; their number follows from
  ``recall`` and ``agree``, the share of positions on which windows at the limit agree.
* Around windows that collide with an item in some table, widened by ``k`` words on both sides, the
  run with the fewest edits is found by exact edit distance with free ends.

Items are broadcast in blocks of at most ``block_items`` items and about ``block_bytes`` of text; more items
mean more blocks, not larger ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import textcore

_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class CgkConfig:
    """``burst``: matches of q-grams that are looked at together."""

    edit_share: float = 0.2
    recall: float = 0.995
    agree: float = 0.5
    sample: int = 3
    walks: int = 4
    block_items: int = 20_000
    block_bytes: int = 32 << 20
    burst: int = 1 << 21
    seed: int = 11

    @property
    def tables(self) -> int:
        """Tables of each walk, so that all of them together reach ``recall``."""
        p = self.agree**self.sample
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - p) / self.walks))


def tokenize(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, byte starts and ends, each row's first word."""
    starts, ends = textcore.runs(_WORD[data], offs)
    return textcore.span_hashes(textcore.LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, offs)


def embed(rows: np.ndarray, walk: int, seed: int) -> np.ndarray:
    """CGK embedding of equally long word sequences: ``3 L`` symbols a row, 0 past the end."""
    n, length = rows.shape
    padded = np.concatenate([rows, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    at, every = np.zeros(n, dtype=np.int64), np.arange(n)
    out = np.empty((n, 3 * length), dtype=np.uint64)
    salts = textcore.mix(np.arange(3 * length, dtype=np.uint64) + _U((seed * 1009 + walk) * 1_000_003))
    for step in range(3 * length):
        symbol = padded[every, at]
        out[:, step] = symbol
        at = np.minimum(at + (textcore.mix(symbol ^ salts[step]) & _U(1)).astype(np.int64), length)
    return out


def lsh_keys(rows: np.ndarray, config: CgkConfig) -> np.ndarray:
    """One key for each table of each walk."""
    length, keys = rows.shape[1], []
    for walk in range(config.walks):
        sketch = embed(rows, walk, config.seed)
        pick = np.random.default_rng([config.seed, walk, length]).integers(0, 3 * length, (config.tables, config.sample))
        for spots in pick:
            key = np.full(len(rows), len(keys), dtype=np.uint64)
            for spot in spots:
                key = textcore.mix(key * _U(0xA0761D6478BD642F) + sketch[:, spot])
            keys.append(key)
    return np.stack(keys, axis=1)


def best_run(words: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the run of ``words`` that is nearest to ``item``: the first to end, then nearest in length."""
    edits = _last_row(words, item, free=True)
    end = int(np.argmin(edits))
    back = _last_row(words[:end][::-1], item[::-1], free=False)
    sizes = np.flatnonzero(back == edits[end])
    return int(edits[end]), end - int(sizes[np.argmin(np.abs(sizes - len(item)))]), end


def _last_row(words: np.ndarray, item: np.ndarray, free: bool) -> np.ndarray:
    """Edits between ``item`` and the words up to each place, from the first one or (``free``) from any."""
    steps = np.arange(len(words) + 1)
    now = np.zeros_like(steps) if free else steps
    for i, symbol in enumerate(item, 1):
        best = np.minimum(now[1:] + 1, now[:-1] + (words != symbol))
        now = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
    return now


@dataclass
class _Items:
    """A block of benchmark items, ready for search."""

    ids: np.ndarray
    words: list[np.ndarray]
    config: CgkConfig

    def __post_init__(self) -> None:
        self.limit = [int(self.config.edit_share * len(w)) for w in self.words]
        self.width = [max(1, min(3, len(w) // (k + 1))) for w, k in zip(self.words, self.limit, strict=True)]
        self.need = [max(1, len(w) - q + 1 - k * q) for w, k, q in zip(self.words, self.limit, self.width, strict=True)]
        self.keys = [lsh_keys(w[None, :], self.config)[0] if len(w) else None for w in self.words]
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.maybe: dict[int, np.ndarray] = {}
        for q in sorted({q for q, w in zip(self.width, self.words, strict=True) if len(w)}):
            g = [(grams(w, q), i) for i, w in enumerate(self.words) if len(w) and self.width[i] == q]
            keys = np.concatenate([np.unique(x) for x, _ in g])
            owner = np.concatenate([np.full(len(np.unique(x)), i) for x, i in g])
            order = np.argsort(keys, kind="stable")
            self.grams[q] = keys[order], owner[order]
            self.maybe[q] = np.zeros(1 << 22, dtype=bool)
            self.maybe[q][keys >> _U(42)] = True


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of ``q`` consecutive words at each place where they fit."""
    n = max(0, len(words) - q + 1)
    h = np.full(n, q, dtype=np.uint64)
    for k in range(q):
        h = textcore.mix(h * _U(0xC2B2AE3D27D4EB4F) + words[k : k + n])
    return h


def _matches(items: _Items, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, item, places of shared q-grams) for each row and item that share enough of them."""
    for q, (keys, owner) in items.grams.items():
        g = grams(words, q)
        spots = np.flatnonzero(items.maybe[q][g >> _U(42)])
        lo, hi = np.searchsorted(keys, g[spots], "left"), np.searchsorted(keys, g[spots], "right")
        row = np.searchsorted(first, spots, "right") - 1
        real = (hi > lo) & (spots + q <= first[row + 1])
        spots, lo, count, row = spots[real], lo[real], (hi - lo)[real], row[real]
        if not len(spots):
            continue
        # A gram that many items hold is spread out in parts, so that memory stays bounded.
        part = np.cumsum(count) // items.config.burst
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))

        def spread(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            n = count[a:b]
            who = owner[np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            return np.repeat(row[a:b], n).astype(np.int64) * len(items.words) + who, np.repeat(spots[a:b], n)

        parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        need = np.array(items.need)
        if len(parts) == 1:
            pair, at = spread(*parts[0])
        else:
            seen, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for a, b in parts:
                both, n = np.unique(spread(a, b)[0], return_counts=True)
                seen, back = np.unique(np.concatenate([seen, both]), return_inverse=True)
                total = np.bincount(back, np.concatenate([total, n]), len(seen)).astype(np.int64)
            enough = seen[total >= need[seen % len(items.words)]]
            kept = [(p[ok], s[ok]) for a, b in parts for p, s in [spread(a, b)] for ok in [np.isin(p, enough)]]
            pair, at = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((at, pair))
        pair, at = pair[order], at[order]
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(pair) else np.zeros(1, dtype=np.int64)
        who = pair[edge[:-1]] % len(items.words)
        for j in np.flatnonzero(np.diff(edge) >= need[who]):
            yield int(pair[edge[j]]) // len(items.words), int(who[j]), at[edge[j] : edge[j + 1]]


def _search(items: _Items, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, word after the last, edits) of the best run for each leaked item in each row."""
    out = []
    for r, i, at in _matches(items, words, first):
        item, k = items.words[i], items.limit[i]
        length, begin, end = len(item), int(first[r]), int(first[r + 1])
        starts = _starts(at, items, i, begin, end)
        if not len(starts):
            continue
        near = []
        for a in range(0, len(starts), 4096):
            some = starts[a : a + 4096]
            place = some[:, None] + np.arange(length)
            rows = np.where(place < end, words[np.minimum(place, end - 1)], _U(0))
            near.append(some[(lsh_keys(rows, items.config) == items.keys[i]).any(axis=1)])
        near = np.concatenate(near)
        if not len(near):
            continue
        best = (k + 1, 0, 0)
        breaks = np.flatnonzero(np.diff(near) > length + 2 * k)
        for a, b in zip(near[np.concatenate([[0], breaks + 1])].tolist(), near[np.concatenate([breaks, [len(near) - 1]])].tolist(), strict=True):
            low = max(begin, a - k)
            edits, x, y = best_run(words[low : min(end, b + length + k)], item)
            best = min(best, (edits, low + x, low + y))
        if best[0] <= k:
            out.append((r, i, best[1], best[2], best[0]))
    return out


def _starts(at: np.ndarray, items: _Items, i: int, begin: int, end: int) -> np.ndarray:
    """Where a run within the limit of edits may start: enough q-gram hits lie in the longest run from there."""
    length, q, need, k = len(items.words[i]), items.width[i], items.need[i], items.limit[i]
    # A run [s, s + length + k) holds the hits at[j .. j + need - 1] when both ends fit.
    lo = np.maximum(at[need - 1 :] + q - length - k, begin)
    hi = np.minimum(at[: len(at) - need + 1], end - (length - k))
    marks = np.zeros(end - begin + 2, dtype=np.int64)
    fits = lo <= hi
    np.add.at(marks, lo[fits] - begin, 1)
    np.add.at(marks, hi[fits] + 1 - begin, -1)
    return np.flatnonzero(np.cumsum(marks) > 0) + begin


def _blocks(items: DataFrame, id_col: str, text_col: str, config: CgkConfig) -> Iterator[_Items]:
    """Items in blocks. They come to the driver a partition at a time, and no block exceeds its bounds by more than an item."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    ids, words, size = [], [], 0
    for row in rows.toLocalIterator():
        raw = row.text.encode()
        if ids and (len(ids) >= config.block_items or size + len(raw) > config.block_bytes):
            yield _Items(np.array(ids, dtype=np.int64), words, config)
            ids, words, size = [], [], 0
        ids.append(row.id)
        words.append(tokenize(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0])
        size += len(raw)
    if ids:
        yield _Items(np.array(ids, dtype=np.int64), words, config)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", config: CgkConfig = CgkConfig()) -> DataFrame:
    """(id, item_id, edits, item_words, start_byte, end_byte): one row per document and leaked item.

    The span, in the UTF-8 text, is that of the best run (fewest edits, then first) around the windows
    that the tables found. Null, empty and wordless texts leak nothing; items without words or id are
    never leaked. Repeated documents give repeated results, and so do repeated items; items that
    repeat an id with other texts are each looked for. A null document id stays null. Other columns
    are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    schema = f"{id_col} long, {item_id_col} long, edits int, item_words int, start_byte long, end_byte long"
    names = [x.split()[0] for x in schema.split(", ")]
    for block in _blocks(items, item_id_col, item_text_col, config):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            have = sent.value
            for batch in batches:
                for lo, hi, data, offs in textcore.slices(batch.column(1)):
                    words, starts, ends, first = tokenize(data, offs)
                    found = _search(have, words, first)
                    if found:
                        rows, who, at, stop, edits = map(np.array, zip(*found, strict=True))
                        size = np.array([len(have.words[i]) for i in who])
                        yield pa.record_batch([batch.column(0).take(pa.array(rows + lo)), pa.array(have.ids[who]), pa.array(edits, pa.int32()), pa.array(size, pa.int32()), pa.array(starts[at] - offs[rows]), pa.array(ends[stop - 1] - offs[rows])], names=names)

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaking(docs: DataFrame, items: DataFrame, text_col: str = "text", config: CgkConfig = CgkConfig()) -> DataFrame:
    """Documents without any leaked item; every column is kept. Runs inside the scan: no shuffle."""
    out = docs
    for block in _blocks(items, "item_id", "text", config):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            have = sent.value
            for batch in batches:
                bad = np.zeros(batch.num_rows, dtype=bool)
                for lo, _, data, offs in textcore.slices(batch.column(batch.schema.get_field_index(text_col))):
                    words, _, _, first = tokenize(data, offs)
                    for r, *_ in _search(have, words, first):
                        bad[lo + r] = True
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(run, docs.schema)
    return out

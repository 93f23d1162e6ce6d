"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions along a prefix tree; each decision has its own context tree over
the last ``depth`` bytes. Every node holds a Krichevsky-Trofimov estimate of the counts that it
saw, and the tree weighs, at each node, stopping there against going one byte deeper:
``Pw = Pe / 2 + (product of the children's Pw) / 2``. A bit's probability mixes all depths by these
weights. A text is its UTF-8 bytes and an end, so probabilities of all texts sum to one.

Counts cover all training documents and are summed by Spark, and every trained context is a node at
every depth. Contexts of up to ``TOP`` bytes are weighted on the driver (at most 2 ** 24 pairs, whatever
the corpus); the trees below them are dealt out by the last ``TOP + 1`` bytes of context and weighted in
tasks. So each pair of the corpus gets its score once: the ``entries`` pairs that occur most are
broadcast, and all others are joined to the texts that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm import textcore
from almanack.llm.storage import materialise

_U = np.uint64
GRAM, WORD = 0, 1
#: The longest contexts that the driver weighs.
TOP = 2
#: The key of the token that ends each text; words are never hashed to it but by chance.
END = 0


@dataclass(frozen=True)
class CtwConfig:
    """``entries``: size bound of the broadcast scores of (context, byte) pairs, and ``hot_words`` of the
    broadcast word counts (all others are joined). ``flush``: distinct keys that a task holds."""

    depth: int = 5
    entries: int = 1 << 20
    hot_words: int = 1 << 17
    flush: int = 1 << 20


def spread(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) key of every byte and of each row's end, row by row; each row's first key.

    The bytes before a row's first are zeros, and so is its end.
    """
    rows = len(offs) - 1
    size = np.diff(offs)
    row = np.repeat(np.arange(rows), size)
    wide = np.zeros(len(data) + (depth + 1) * rows, dtype=np.uint64)
    wide[np.arange(len(data)) + row * (depth + 1) + depth] = data
    keys = np.zeros(max(0, len(wide) - depth), dtype=np.uint64)
    for k in range(depth + 1):
        keys = (keys << _U(8)) | wide[k : len(wide) - depth + k]
    real = np.ones(len(wide), dtype=bool)
    begin = offs[:-1] + np.arange(rows) * (depth + 1)
    for k in range(depth):
        real[begin + k] = False
    return keys[real[depth:]], offs + np.arange(rows + 1)


class _Tally:
    """Counts of keys, handed on when there are many; ``trained``: whether the model learns them."""

    def __init__(self, kind: int, limit: int, trained: bool = True) -> None:
        self.kind, self.limit, self.trained, self.parts, self.size = kind, limit, trained, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, c = np.unique(keys, return_counts=True)
        self.parts.append((u, c))
        self.size += len(u)
        if self.size > self.limit:
            self._merge()
            if self.size > self.limit // 2:
                yield from self.end()

    def _merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        u, back = np.unique(keys, return_inverse=True)
        self.parts = [(u, np.bincount(back, counts, len(u)).astype(np.int64))]
        self.size = len(u)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            u, c = self.parts[0]
            self.parts, self.size = [], 0
            for a in range(0, len(u), 1 << 17):
                part, n = u[a : a + (1 << 17)], c[a : a + (1 << 17)]
                yield pa.record_batch([pa.array(np.full(len(part), self.kind, dtype=np.int32)), pa.array(part.view(np.int64)), pa.array(n * self.trained), pa.array(n)], names=["kind", "key", "c", "n"])


def count_corpus(texts: DataFrame, config: CtwConfig) -> DataFrame:
    """(kind, key, c, n): counts of (context, byte) keys and of words in ``texts(text, held)``.

    ``c`` counts the rows that are not held out (all, without that column), ``n`` all rows; words are
    only counted in the former.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, others, words = _Tally(GRAM, config.flush), _Tally(GRAM, config.flush, trained=False), _Tally(WORD, config.flush)
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in textcore.slices(batch.column(0)):
                keys, first = spread(data, offs, config.depth)
                out = np.repeat(held[lo:hi], np.diff(first))
                yield from grams.add(keys[~out])
                yield from others.add(keys[out])
                word, _, _, at = textcore.words(data, offs)
                yield from words.add(np.concatenate([word[np.repeat(~held[lo:hi], np.diff(at))], np.full((~held[lo:hi]).sum(), END, dtype=np.uint64)]))
        for tally in (grams, others, words):
            yield from tally.end()

    held = F.col("held") if "held" in texts.columns else F.lit(False)
    part = texts.select("text", held.alias("held")).mapInArrow(run, "kind int, key long, c long, n long")
    return materialise(part.groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "counts")


def _at_least(counts: DataFrame, by: str, bound: int) -> float | None:
    """The least total of ``by`` whose rows, with all of higher total, fit ``bound`` (in half octaves); None: none fits."""
    bands = counts.withColumn("band", F.floor(2 * F.log2(by))).groupBy("band").agg(F.sum("rows").alias("rows")).orderBy(F.desc("band")).collect()  # at most 128
    least, left = None, bound
    for r in bands:
        left -= r["rows"]
        if left < 0:
            break
        least = 2.0 ** (r["band"] / 2)
    return least


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1.0)


class Ctw:
    """Weighted trees from (context, byte) counts for depths ``first`` and on, one table each.

    ``sums``: the nodes of the last depth that have children elsewhere, and the log of their product.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], first: int = 0, sums: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.first, self.keys, self.stop, self.one = first, [], [], []
        weighted = None
        for d in range(first + len(tables) - 1, first - 1, -1):
            keys, a, b = self._nodes(*tables[d - first])
            own = kt(a, b)
            if self.keys:
                at, fits = self._parents(self.keys[0], keys, d)
                below = np.bincount(at, weighted[fits], len(keys))
            elif sums is not None:
                below = np.zeros(len(keys))
                below[np.searchsorted(keys, sums[0])] = sums[1]
            else:
                below = None
            weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
            self.stop.insert(0, np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - weighted))
            self.keys.insert(0, keys)
            self.one.insert(0, (b + 0.5) / (a + b + 1))
        self.weighted = weighted

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The parents of the first depth's nodes, and the log of the product of their children."""
        keys, d = self.keys[0], self.first - 1
        parent, back = np.unique((((keys >> _U(8)) & _U((1 << (8 * d)) - 1)) << _U(8)) | (keys & _U(255)), return_inverse=True)
        return parent, np.bincount(back, self.weighted, len(parent))

    @staticmethod
    def _parents(child: np.ndarray, keys: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of each child's parent (its context without the oldest byte), and which have one."""
        if not len(keys):
            return np.zeros(0, dtype=np.int64), np.zeros(len(child), dtype=bool)
        parent = (((child >> _U(8)) & _U((1 << (8 * d)) - 1)) << _U(8)) | (child & _U(255))
        at = np.minimum(np.searchsorted(keys, parent), len(keys) - 1)
        fits = keys[at] == parent
        return at[fits], fits

    @staticmethod
    def _nodes(entries: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes (context, prefix of a byte) with their counts of zeros and ones."""
        context, byte = entries >> _U(8), entries & _U(255)
        keys, ones = [], []
        for i in range(8):
            keys.append((context << _U(8)) | (_U(1 << i) | (byte >> _U(8 - i))))
            ones.append((byte >> _U(7 - i)) & _U(1))
        keys, one, c = np.concatenate(keys), np.concatenate(ones).astype(bool), np.tile(counts.astype(np.float64), 8)
        u, back = np.unique(keys, return_inverse=True)
        return u, np.bincount(back[~one], c[~one], len(u)), np.bincount(back[one], c[one], len(u))

    def ones(self, entries: np.ndarray, under: np.ndarray | None = None) -> np.ndarray:
        """For each entry and bit of its byte, the probability of a one, given context and bits before.

        ``under``: the same by the trees below the last depth.
        """
        out, byte = np.zeros((len(entries), 8)), entries & _U(255)
        for i in range(8):
            prefix = _U(1 << i) | (byte >> _U(8 - i))
            p, share, open_ = np.zeros(len(entries)), np.ones(len(entries)), np.ones(len(entries), dtype=bool)
            for d, keys, stop, one in zip(range(self.first, self.first + len(self.keys)), self.keys, self.stop, self.one, strict=True):
                node = (((entries >> _U(8)) & _U((1 << (8 * d)) - 1)) << _U(8)) | prefix
                at = np.minimum(np.searchsorted(keys, node), max(0, len(keys) - 1))
                seen = open_ & (keys[at] == node) if len(keys) else np.zeros(len(node), dtype=bool)
                p = np.where(open_ & ~seen, p + share * 0.5, p)
                if len(keys):
                    p = np.where(seen, p + share * stop[at] * one[at], p)
                    share = np.where(seen, share * (1 - stop[at]), share)
                open_ = seen
            out[:, i] = np.where(open_, p + share * (0.5 if under is None else under[:, i]), p)
        return out

    def log10(self, entries: np.ndarray, under: np.ndarray | None = None) -> np.ndarray:
        """log10 of each entry's byte, given its context."""
        one = ((entries[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & _U(1)).astype(bool)
        p = np.clip(self.ones(entries, under), 1e-12, 1 - 1e-12)
        return np.log10(np.where(one, p, 1 - p)).sum(axis=1)

    score = log10


class Scores:
    """An open-addressing table of distinct keys and their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = 64 - max(10, int(2 * len(keys)).bit_length())
        self.slot = np.full(1 << (64 - self.shift), _ALL, dtype=np.uint64)
        self.value = np.zeros(len(self.slot))
        spot, left = self._spot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot[spot[left]] == _ALL]
            _, first = np.unique(spot[free], return_index=True)
            put = free[first]
            self.slot[spot[put]], self.value[spot[put]] = keys[put], values[put]
            left = left[self.slot[spot[left]] != keys[left]]
            spot[left] = (spot[left] + 1) & (len(self.slot) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of every key, 0 where there is none, and the places of the keys without one."""
        spot = self._spot(keys)
        have = self.slot[spot]
        out = self.value[spot]
        left = np.flatnonzero(have != keys)
        lost = []
        while len(left):
            gone = self.slot[spot[left]] == _ALL
            lost.append(left[gone])
            left = left[~gone]
            spot[left] = (spot[left] + 1) & (len(self.slot) - 1)
            hit = self.slot[spot[left]] == keys[left]
            out[left[hit]] = self.value[spot[left[hit]]]
            left = left[~hit]
        lost = np.sort(np.concatenate([*lost, np.zeros(0, dtype=np.int64)]))
        out[lost] = 0
        return out, lost


_ALL = _U(0xFFFFFFFFFFFFFFFF)


def _tables(entries: np.ndarray, counts: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (context, byte) counts of depths ``first`` to ``last`` from those of a longer context."""
    out = []
    for d in range(first, last + 1):
        u, back = np.unique(entries & _U((1 << (8 * (d + 1))) - 1), return_inverse=True)
        out.append((u, np.bincount(back, counts, len(u))))
    return out


def lower(counts: DataFrame, config: CtwConfig) -> DataFrame:
    """The trees below ``TOP``: (key, n, under, total), written.

    A row with ``under`` is a (context, byte) pair of the corpus and its ``ones`` by these trees; a row
    with ``total`` is a node of depth ``TOP`` and the log of its children's product, by parts to be summed.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Whole contexts of ``TOP + 1`` bytes: their groups, keys, counts."""
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut == 0 and parts and parts[-1][0][-1] != columns[0][0]:
                yield [np.concatenate(c) for c in zip(*parts, strict=True)]
                parts = []
            if cut:
                yield [np.concatenate(c) for c in zip(*parts, [c[:cut] for c in columns], strict=True)]
                parts = []
            parts.append([c[cut:] for c in columns])
        if parts:
            yield [np.concatenate(c) for c in zip(*parts, strict=True)]

    def rows(keys: np.ndarray, n: np.ndarray | None, under: np.ndarray | None, total: np.ndarray | None) -> pa.RecordBatch:
        size = len(keys)
        lists = pa.nulls(size, pa.list_(pa.float64())) if under is None else pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * size + 1, 8, dtype=np.int32)), pa.array(under.ravel(), pa.float64()))
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.nulls(size, pa.int64()) if n is None else pa.array(n), lists, pa.nulls(size, pa.float64()) if total is None else pa.array(total, pa.float64())], names=["key", "n", "under", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, c, n in chunks(batches):
            key, trained = key.view(np.uint64), c > 0
            trees = Ctw(_tables(key[trained], c[trained], TOP + 1, config.depth), TOP + 1)
            for a in range(0, len(key), 1 << 16):
                yield rows(key[a : a + (1 << 16)], n[a : a + (1 << 16)], trees.ones(key[a : a + (1 << 16)]), None)
            node, total = trees.sums()
            yield rows(node, None, None, total)

    grams = counts.filter(F.col("kind") == GRAM).select(F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * (TOP + 1))) - 1).alias("context"), "key", "c", "n")
    if config.depth <= TOP:
        return grams.select("key", "n", F.array_repeat(F.lit(0.5), 8).alias("under"), F.lit(None).cast("double").alias("total"))
    return materialise(grams.repartition("context").sortWithinPartitions("context").mapInArrow(run, "key long, n long, under array<double>, total double"), "lower")


def fit(counts: DataFrame, config: CtwConfig, below: DataFrame | None = None) -> Ctw:
    """The trees of up to ``TOP`` bytes of context over those ``below`` (``lower``), on the driver."""
    below = lower(counts, config) if below is None else below
    top = min(TOP, config.depth)
    pair = F.col("key").bitwiseAND((1 << (8 * (top + 1))) - 1).alias("key")
    rows = counts.filter((F.col("kind") == GRAM) & (F.col("c") > 0)).groupBy(pair).agg(F.sum("c").alias("c")).toArrow()
    tables = _tables(rows.column("key").to_numpy().view(np.uint64), rows.column("c").to_numpy(), 0, top)
    if config.depth == top:
        return Ctw(tables)
    rows = below.filter("total is not null").groupBy("key").agg(F.sum("total").alias("total")).toArrow()
    return Ctw(tables, sums=(rows.column("key").to_numpy().view(np.uint64), rows.column("total").to_numpy()))


def score_pairs(below: DataFrame, model) -> DataFrame:
    """(key, value): log10 of each pair of ``lower``, by the broadcast trees above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            under = batch.column(1).flatten().to_numpy().reshape(-1, 8)
            value = model.value.log10(batch.column(0).to_numpy().view(np.uint64), under)
            yield pa.record_batch([batch.column(0), pa.array(value)], names=["key", "value"])

    return below.filter("total is null").select("key", "under").mapInArrow(run, "key long, value double")


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, config: CtwConfig = CtwConfig()) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``score`` is the model's log10 probability of the whole text, ``base_score`` that of its words
    and their end under the add-one unigram model. Null texts are empty (one token, the end).
    Repeated ids and rows are scored each. An empty table gives an empty result, and a table with
    nothing to learn from gives the uniform model.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col), parts, part).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = count_corpus(base.select("text", "held"), config)
    below = lower(counts, config)
    model = spark.sparkContext.broadcast(fit(counts, config, below))
    many = _at_least(counts.filter(F.col("kind") == GRAM).withColumn("rows", F.lit(1)), "n", config.entries)
    rows = score_pairs(below.filter(F.col("n") >= many * 0.999 if many else F.lit(False)), model).toArrow()
    pairs = spark.sparkContext.broadcast(Scores(rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy()))
    words = counts.filter(F.col("kind") == WORD).select("key", "c")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = _at_least(words.withColumn("rows", F.lit(1)), "c", config.hot_words)
    often = words.filter(F.col("c") >= least * 0.999 if least else F.lit(False))
    rows = often.toArrow()
    keys, c = rows.column("key").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], np.log10(c[order] + 1.0)))
    scored = materialise(base.mapInArrow(_scorer(pairs, hot, config), "uid long, id long, held boolean, n_tokens long, n_bytes long, known long, logs double, score double, rare array<long>, rare_pairs array<long>"), "scored")
    rare = scored.select("uid", F.lit(WORD).alias("kind"), F.explode("rare").alias("key")).unionAll(scored.select("uid", F.lit(GRAM), F.explode("rare_pairs")))
    cold = (words.filter(F.col("c") < least * 0.999) if least else words).select(F.lit(WORD).alias("kind"), "key", F.log10(F.col("c") + 1.0).alias("value"))
    cold = cold.unionAll(score_pairs(below.filter(F.col("n") < many * 0.999) if many else below, model).select(F.lit(GRAM), "key", "value"))
    worth = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value")))
    more = rare.join(cold, ["kind", "key"]).groupBy("uid").agg(F.count(F.when(F.col("kind") == WORD, 1)).alias("more"), worth(WORD).alias("more_logs"), worth(GRAM).alias("more_score"))
    out = scored.drop("rare", "rare_pairs").join(more, "uid", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    base_score = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def _scorer(pairs, hot, config: CtwConfig):
    def lists(row: np.ndarray, keys: np.ndarray, rows: int) -> pa.ListArray:
        """The keys of each row, which need not be in order."""
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[np.argsort(row, kind="stable")].view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (keys, logs) = pairs.value, hot.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offs in textcore.slices(batch.column(2)):
                entry, first = spread(data, offs, config.depth)
                value, lost = table.find(entry)
                score = np.add.reduceat(value, first[:-1])
                word, _, _, at = textcore.words(data, offs)
                rows = hi - lo
                row = np.concatenate([np.repeat(np.arange(rows), np.diff(at)), np.arange(rows)])
                word = np.concatenate([word, np.full(rows, END, dtype=np.uint64)])
                spot = np.minimum(np.searchsorted(keys, word), max(0, len(keys) - 1))
                hit = keys[spot] == word if len(keys) else np.zeros(len(word), dtype=bool)
                known = np.bincount(row[hit], minlength=rows)
                sums = np.bincount(row[hit], logs[spot[hit]], rows) if len(keys) else np.zeros(rows)
                miss = np.flatnonzero(~hit)
                part = batch.slice(lo, rows)
                rare, rare_pairs = lists(row[miss], word[miss], rows), lists(np.searchsorted(first, lost, "right") - 1, entry[lost], rows)
                yield pa.record_batch([pa.array(uid + np.arange(rows)), part.column(0), part.column(1), pa.array(np.bincount(row, minlength=rows)), pa.array(np.diff(offs)), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(score, pa.float64()), rare, rare_pairs], names=["uid", "id", "held", "n_tokens", "n_bytes", "known", "logs", "score", "rare", "rare_pairs"])
                uid += rows

    return run

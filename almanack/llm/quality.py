"""Quality classifier by co-training on two views of a document.

The text view measures the text itself; the metadata view sees only the page's columns
(language, source, length). Each view has a logistic classifier. In every round, each one labels
the unlabelled documents that it is most sure of, in the class proportions of the labels, and
hands them to the other view; then both are fitted again. At the end each view is calibrated on
held-out labelled rows and the calibrated views are combined by a logistic model fitted there.

Fitting uses a bounded, hash-chosen sample (``labelled``, ``pool``); scoring covers every row and
runs inside the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm import textcore

_BUCKETS = 32
TEXT_FEATURES = 18
META_FEATURES = 2 + 8 + _BUCKETS


@dataclass(frozen=True)
class CoTrainConfig:
    """``labelled`` and ``pool`` bound the rows that fitting sees; ``threshold`` is the lowest score kept."""

    labelled: int = 6000
    pool: int = 6000
    rounds: int = 4
    sure: float = 0.9
    per_round: int = 600
    threshold: float = 0.5


def text_view(texts: pa.Array) -> np.ndarray:
    """Shape statistics of each whole text, all in fixed ranges; an empty or null text is all zeros."""
    out = np.zeros((len(texts), TEXT_FEATURES), dtype=np.float64)
    for lo, hi, data, offs in textcore.slices(texts):
        word, starts, ends, first = textcore.words(data, offs)
        size, count = np.maximum(np.diff(offs), 1), np.diff(first)
        per_byte = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offs])  # noqa: E731,B023
        upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        digit, high = (data >= 48) & (data <= 57), data >= 128
        mark = ~(upper | lower | digit | high | textcore.IS_SPACE[data])
        plain = np.isin(data, np.frombuffer(b".,;:'\"-?", dtype=np.uint8))
        length = ends - starts
        by_word = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[first]) / np.maximum(count, 1)  # noqa: E731,B023
        marks_in = np.concatenate([[0], np.cumsum(mark & ~plain)])
        odd_word = (marks_in[ends] - marks_in[starts] > 0) if len(starts) else np.zeros(0, dtype=bool)
        alone = odd_word & (marks_in[ends] - marks_in[starts] == length) if len(starts) else odd_word
        again = np.zeros(len(word), dtype=bool)
        again[1:] = word[1:] == word[:-1]
        pair_again = np.zeros(len(word), dtype=bool)
        pair_again[2:] = word[2:] == word[:-2]
        start = first[:-1][count > 0]  # what stands before a row's first words belongs to another row
        again[start] = pair_again[start] = False
        pair_again[np.minimum(start + 1, len(word) - 1)] = False
        distinct, top = np.ones(hi - lo), np.zeros(hi - lo)
        for i in range(hi - lo):
            w = np.sort(word[first[i] : first[i + 1]])
            if len(w):
                cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
                distinct[i], top[i] = (len(cuts) - 1) / len(w), np.diff(cuts).max() / len(w)
        lines = per_byte(data == 10) + 1
        out[lo:hi] = np.stack(
            [
                per_byte(upper) / size,
                per_byte(lower) / size,
                per_byte(digit) / size,
                per_byte(high) / size,
                per_byte(mark & ~plain) / size,
                per_byte(plain) / size,
                by_word(length) / 16,
                by_word(length > 12),
                by_word(length <= 2),
                by_word(odd_word),
                by_word(alone),
                by_word(again),
                by_word(pair_again),
                distinct,
                top,
                np.minimum(per_byte((data == 46) | (data == 63)) / np.maximum(count, 1), 1),
                np.minimum(lines / np.maximum(count, 1), 1),
                np.log1p(count) / 10,
            ],
            axis=1,
        ) * (count > 0)[:, None]
    return out


def meta_view(lang: list, source: list, chars: np.ndarray) -> np.ndarray:
    """Columns of the page: size, hashed language and source; nulls have a bucket of their own."""
    out = np.zeros((len(lang), META_FEATURES))
    out[:, 0] = np.log1p(np.maximum(chars, 0)) / 12
    out[:, 1] = out[:, 0] ** 2
    for i, (x, y) in enumerate(zip(lang, source, strict=True)):
        out[i, 2 + zlib.crc32(str(x).encode()) % 8] = 1
        out[i, 10 + zlib.crc32(str(y).encode()) % _BUCKETS] = 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised features.

    Features are held to the range that fitting saw, so nothing is judged by extrapolation.
    """

    ridge: float = 1.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weight: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Logistic:
        w = np.ones(len(y)) if w is None else w
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        b = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            h = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (w * (y - p)) - penalty * b)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.weight = b
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        return np.clip(((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1], -30, 30)

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    final: Logistic
    calibrators: tuple[Logistic, Logistic]

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(calibrated text view, calibrated metadata view, combined) probabilities of good quality."""
        a = self.calibrators[0].logit(self.text.logit(text)[:, None])
        b = self.calibrators[1].logit(self.meta.logit(meta)[:, None])
        sure = lambda v: 1 / (1 + np.exp(-v))
        return sure(a), sure(b), self.final.prob(np.stack([a, b], axis=1))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, config: CoTrainConfig) -> CoTrained:
    """Fit both views with exchange of confident pseudo-labels; every third labelled row calibrates."""
    held = np.arange(len(y)) % 3 == 2
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held[:] = False  # too few labels to hold some out
    fit, check = ~held, held if held.any() else ~held
    prior = y[fit].mean()
    given = [np.full(len(pool_text), np.nan), np.full(len(pool_text), np.nan)]  # what each view was given
    views = [(text, pool_text), (meta, pool_meta)]
    models = [Logistic(), Logistic()]
    for r in range(config.rounds + 1):
        for v, (x, pool) in enumerate(views):
            has = ~np.isnan(given[v])
            models[v].fit(np.concatenate([x[fit], pool[has]]), np.concatenate([y[fit], given[v][has]]), np.concatenate([np.ones(int(fit.sum())), np.full(int(has.sum()), 0.5)]))
        if r == config.rounds or not len(pool_text):
            break
        for v, (_, pool) in enumerate(views):
            p, other = models[v].prob(pool), given[1 - v]
            for label, order, share in ((1.0, np.argsort(-p), prior), (0.0, np.argsort(p), 1 - prior)):
                sure = order[(p[order] if label else 1 - p[order]) >= config.sure]
                new = sure[np.isnan(other[sure])][: max(1, int(config.per_round * share))]
                other[new] = label
    calibrators = tuple(Logistic(ridge=0.1).fit(m.logit(x[check])[:, None], y[check]) for m, (x, _) in zip(models, views, strict=True))
    both = np.stack([c.logit(m.logit(x[check])[:, None]) for c, m, (x, _) in zip(calibrators, models, views, strict=True)], axis=1)
    return CoTrained(*models, Logistic(ridge=0.1).fit(both, y[check]), calibrators)


def _both_views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    col |= {n: pa.nulls(batch.num_rows, pa.string()) for n in _VIEWED if n not in col}
    chars = np.nan_to_num(col["n_chars"].cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
    return text_view(col["text"]), meta_view(col["lang"].to_pylist(), col["source"].to_pylist(), chars)


_VIEWED = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _viewed(docs: DataFrame) -> list[Column]:
    """The columns that the views read; one that the table lacks is null."""
    return [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in _VIEWED.items()]


def sampled(docs: DataFrame, labels: DataFrame, config: CoTrainConfig = CoTrainConfig()) -> DataFrame | None:
    """(doc_id, y, views) of at most ``labelled`` labelled rows and ``pool`` others (y is -1); None when the labels lack one of the classes.

    Of repeated labels of a document the lowest counts. The samples take the smallest hashes of the
    id, of equal hashes the smaller id, and of a labelled id that repeats one row, that of the smallest hash,
    so they are bounded, and the same in every layout of the table. Columns of ``text``, ``lang``, ``source`` and ``n_chars`` that the
    table lacks count as null.
    """
    spark = docs.sparkSession
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    # A few more are picked than asked for, to be cut exactly once they are here; both counts are bounded.
    total = marked.count()
    span = 1 << 30
    near = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    some = marked.filter(near < int(span * min(1.0, 1.2 * config.labelled / max(total, 1)))) if total > config.labelled else marked
    picked = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.labelled)
    names = [f"t{i}" for i in range(TEXT_FEATURES)] + [f"m{i}" for i in range(META_FEATURES)]
    shape = "doc_id long, y int, near long, " + ", ".join(f"{n} double" for n in names)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _both_views(batch)
            yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.int32()), batch.column(2), *map(pa.array, text.T.copy()), *map(pa.array, meta.T.copy())], names=["doc_id", "y", "near", *names])

    base = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), *_viewed(docs)).withColumn("near", F.xxhash64("text", "lang", "source", "n_chars"))
    ids = picked.toPandas()  # at most ``labelled`` pairs of ids and labels
    if ids["y"].nunique() < 2:
        return None
    small = spark.createDataFrame(ids.astype({"doc_id": "int64", "y": "int32"}), "doc_id long, y int")
    seen = lambda rows: rows.select("doc_id", "y", "near", *_VIEWED).mapInArrow(features, shape)  # noqa: E731  texts end here, in the scan
    first = Window.partitionBy("doc_id").orderBy("near", *names)
    known = seen(base.join(F.broadcast(small), "doc_id")).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    others = max(1, docs.agg(F.approx_count_distinct("doc_id")).first()[0] - len(ids))  # by ids, as one may hold many rows
    share = int(span * min(1.0, (1.5 * config.pool + 100) / others))
    turn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(span))
    extra = seen(base.filter(turn < share).join(F.broadcast(small.select("doc_id")), "doc_id", "left_anti").withColumn("y", F.lit(-1)))
    extra = extra.orderBy(turn, "doc_id", "near", *names).limit(config.pool)
    return known.unionByName(extra).drop("near")


def fit_quality(docs: DataFrame, labels: DataFrame, config: CoTrainConfig = CoTrainConfig()) -> CoTrained | None:
    """Fit on a bounded sample (see ``sampled``); None when the labels lack one of the classes."""
    some = sampled(docs, labels, config)
    if some is None:
        return None
    table = some.toPandas().sort_values(["doc_id", "y"] + [f"t{i}" for i in range(TEXT_FEATURES)], kind="stable")  # at most ``labelled`` and ``pool`` rows
    x = table.filter(regex="^t").to_numpy(), table.filter(regex="^m").to_numpy()
    y = table["y"].to_numpy()
    has = y >= 0
    if len(np.unique(y[has])) < 2:
        return None
    return co_train(x[0][has], x[1][has], y[has].astype(float), x[0][~has], x[1][~has], config)


def score_quality(docs: DataFrame, model: CoTrained | None, config: CoTrainConfig = CoTrainConfig(), keep_columns: bool = False) -> DataFrame:
    """Every document's scores: (doc_id, text_score, meta_score, score, keep), all rows, inside the scan.

    Without a model (labels of one class or none) all are kept with score 1. Null and empty texts
    are scored as texts without words; repeated rows each. A score equal to the threshold is kept.
    With ``keep_columns``, the rows kept, with all their columns.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    threshold = config.threshold

    def judge(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        have = sent.value
        if have is None:
            one = np.ones(batch.num_rows)
            return one, one, one
        return have.score(*_both_views(batch))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = judge(batch)
            yield pa.record_batch([batch.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch)[2] >= threshold))

    if keep_columns:
        return docs.mapInArrow(good, docs.schema)
    base = docs.select("doc_id", *_viewed(docs))
    return base.mapInArrow(scores, "doc_id long, text_score double, meta_score double, score double, keep boolean")

"""Language identification: family first, then one-versus-one linear SVMs within the family.

Features are counts of hashed runs of one to three bytes of the lower-cased text, as square roots,
scaled to length one. Fitting uses a bounded, hash-chosen sample of each language, whole texts; every
language with a letter in its sample can be predicted. Every row is predicted, inside the scan. Ties go
to the family, and the language, that comes first in the order of names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm import textcore
from almanack.llm.ctw import held_out

# Families of languages; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "semitic": ("am", "ar", "he", "mt"),
    "uralic": ("et", "fi", "hu"),
}


@dataclass(frozen=True)
class LangConfig:
    """Bounds of the fit: ``per_language`` rows of a language at most, and ``rows`` in all, shared among the
    languages there are; each has one row at least, so with more languages than ``rows`` there is one for each."""

    per_language: int = 800
    rows: int = 20_000
    dims: int = 2048
    epochs: int = 30
    ridge: float = 1e-4
    seed: int = 3


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


def features(texts: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit feature rows, and which rows have a letter."""
    out, letters = np.zeros((len(texts), dims), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for lo, hi, data, offs in textcore.slices(texts):
        low = textcore.LOWER[data].astype(np.uint32)
        rows = hi - lo
        row = np.repeat(np.arange(rows), np.diff(offs))
        total = np.zeros(rows * dims)
        gram = np.zeros(len(low), dtype=np.uint32)
        for k in range(3):
            n = len(low) - k
            if n <= 0:
                break
            gram = (gram[:n] << np.uint32(8)) | low[k:]
            inside = row[:n] == row[k:] if k else slice(None)
            spot = ((gram * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x1B873593)) >> np.uint32(15)
            spot = (spot * np.uint32(0xC2B2AE35)) >> np.uint32(32 - int(dims).bit_length() + 1)
            total += np.bincount((row[:n] * dims + spot)[inside], minlength=rows * dims)
        x = np.sqrt(total.reshape(rows, dims))
        out[lo:hi] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        ascii_letter = ((low >= 97) & (low <= 122)).astype(np.int64)
        some = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[offs]) > 0
        for i in np.flatnonzero(~some):
            some[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode())
        letters[lo:hi] = some
    return out, letters


def svm(x: np.ndarray, y: np.ndarray, config: LangConfig) -> np.ndarray:
    """Weights (the last is the offset) of a linear SVM, averaged subgradient steps; y in {-1, 1}."""
    rng = np.random.default_rng(config.seed)
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w, mean, steps = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    balance = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    for epoch in range(config.epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            some = order[a : a + 64]
            steps += 1
            rate = 1 / (config.ridge * (steps + 10_000 * 0.2))
            wrong = y[some] * (x[some] @ w) < 1
            w = (1 - rate * config.ridge) * w + rate * (x[some][wrong].T @ (y[some] * balance[some])[wrong]) / len(some)
            if epoch >= config.epochs // 2:
                mean += w
    return mean / max(1, steps - steps * (config.epochs // 2) // config.epochs)


@dataclass
class LangModel:
    langs: list[str]
    families: list[str]
    family_weights: np.ndarray  # one against the rest, a row for each family
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the predicted language, and a score between 0 and 1."""
        squash = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
        x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
        if len(self.families) > 1:
            margin = x @ self.family_weights.T
            chosen, sure = margin.argmax(axis=1), squash(margin.max(axis=1))
        else:
            chosen, sure = np.zeros(len(x), dtype=int), np.ones(len(x))
        lang, score = np.zeros(len(x), dtype=int), sure.copy()
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            members = [i for i, one in enumerate(self.langs) if family(one) == name]
            votes, strength = np.zeros((len(rows), len(self.langs))), np.zeros((len(rows), len(self.langs)))
            for a, b, w in self.pairs[name]:
                p = squash(x[rows] @ w)
                votes[:, a] += p > 0.5
                votes[:, b] += p <= 0.5
                strength[:, a] += p
                strength[:, b] += 1 - p
            rank = votes[:, members] + strength[:, members] / (1 + len(members))
            best = rank.argmax(axis=1) if len(rows) else np.zeros(0, dtype=int)
            lang[rows] = np.array(members)[best]
            if len(members) > 1:
                score[rows] *= strength[rows * 0 + np.arange(len(rows)), np.array(members)[best]] / (len(members) - 1)
        return lang, np.clip(score, 0, 1)


def sampled(docs: DataFrame, config: LangConfig = LangConfig()) -> DataFrame | None:
    """(doc_id, lang, x) of the rows that teach: at most ``per_language`` a language. None: no such rows.

    Of each language the rows of the smallest hashes are used, repeated rows among them one by one, so the
    bound holds whatever repeats. A table without a column ``lang`` teaches nothing.
    """
    if "lang" not in docs.columns:
        return None
    rows = docs.filter("text is not null and lang is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    languages = rows.agg(F.countDistinct("lang")).first()[0]
    if not languages:
        return None
    each = max(1, min(config.per_language, config.rows // languages))
    # Hashes alone say which rows are near enough; a few more than are used, as some have no letter.
    rows = rows.withColumn("near", F.xxhash64("doc_id", "text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("near"))
    cuts = rows.select("lang", "near").withColumn("place", first).filter(F.col("place") <= each * 13 // 10 + 30).groupBy("lang").agg(F.max("near").alias("cut"))
    some = rows.join(F.broadcast(cuts), "lang").filter("near <= cut").select("doc_id", "text", "lang", "near")  # a row a language is sent
    dims = config.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, letters = features(batch.column(1), dims)
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["doc_id", "lang", "near", "x"]).filter(pa.array(letters))

    place = F.row_number().over(Window.partitionBy("lang").orderBy("near", "doc_id", "x"))
    seen = some.mapInArrow(run, "doc_id long, lang string, near long, x binary").withColumn("place", place).filter(F.col("place") <= each)
    return seen.select("doc_id", "lang", "x")


def fit_language(docs: DataFrame, config: LangConfig = LangConfig()) -> LangModel | None:
    """Fit on ``docs(doc_id, text, lang)``; rows without text or language teach nothing. None: no such rows."""
    some, dims = sampled(docs, config), config.dims
    if some is None:
        return None
    table = some.toArrow()  # at most ``per_language`` rows a language
    if not table.num_rows:
        return None
    x = np.stack([np.frombuffer(v.as_py(), dtype=np.float16) for v in table.column("x")]).astype(np.float32)
    lang, ids = np.array(table.column("lang").to_pylist()), table.column("doc_id").fill_null(-1).to_numpy()
    order = np.lexsort((x @ np.arange(dims), lang, ids))  # the same order whatever the partitions
    x, lang = x[order], lang[order]
    langs = sorted(set(lang))
    names = sorted({family(one) for one in langs})
    of = np.array([family(one) for one in lang])
    top = np.stack([svm(x, np.where(of == f, 1.0, -1.0), config) for f in names]) if len(names) > 1 else np.zeros((1, dims + 1))
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = {}
    for f in names:
        members = [i for i, one in enumerate(langs) if family(one) == f]
        pairs[f] = []
        for n, a in enumerate(members):
            for b in members[n + 1 :]:
                both = (lang == langs[a]) | (lang == langs[b])
                pairs[f].append((a, b, svm(x[both], np.where(lang[both] == langs[a], 1.0, -1.0), config)))
    return LangModel(langs, names, top, pairs)


def identify(docs: DataFrame, model: LangModel | None, config: LangConfig = LangConfig(), parts: int = 3, part: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only the text decides.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Repeated rows are predicted each, and alike; a null id is never held out. Very long texts are read whole, in
    a task that holds one of them. An empty table gives an empty result. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), parts, part).alias("held_out"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                x, letters = features(rows.column(2), config.dims)
                if have is None:
                    letters[:] = False
                lang, score = have.predict(x) if have is not None else (np.zeros(len(x), dtype=int), np.zeros(len(x)))
                names = [have.langs[i] if ok else "und" for i, ok in zip(lang, letters, strict=True)]
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return base.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_documents(docs: DataFrame, parts: int = 3, part: int = 1, config: LangConfig = LangConfig()) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    return identify(docs, fit_language(docs.filter(~held_out(F.col("doc_id"), parts, part)), config), config, parts, part)

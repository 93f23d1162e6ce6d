"""Catalogue search: a stored index, BM25, bonuses, rank fusion, vectors, and evaluation.

``build_index`` writes what a search needs once: postings by bucket of term, and one short row for each
series. ``search`` ranks by field-weighted BM25 with bonuses for titles, codes and concepts;
``bounded_search`` takes a bounded number of candidates by prefix-matched, column-weighted BM25 and
reorders them. Both prune to the request's terms before anything is exploded or shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.functions.text import detect_language, fold, tokens, unmarked
from almanack.operators import fulltext
from almanack.operators.fulltext import PREFIX_B, PREFIX_K1, TextIndex
from almanack.operators.fulltext import field_text as _text
from almanack.sources.landing import keep

#: Weights of a catalogue row's fields, tokens of a description that count, words that say nothing here.
FIELD_WEIGHTS = {"title": 8.0, "aliases": 3.0, "topic": 2.0, "description": 1.0}
DESCRIPTION_TOKENS = 120
INDEX_STOP = ("the", "of", "and", "for", "in", "to", "a", "by", "on", "at", "with", "total", "all", "data", "index", "annual", "value")
BOUNDED_STOP = (*INDEX_STOP, "from", "between", "since", "during", "over", "show", "give", "me")
#: Parameters of the ranking.
K1, B = 1.5, 0.75
CODE_BONUS, CONCEPT, COVERAGE, PHRASE, PREFIX, SHORT = 1000.0, 40.0, 60.0, 90.0, 70.0, 12.0
CODE_BAND, BOUNDED_SCALE, ALIAS_OVERLAP, SAME_COUNTRY, OTHER_COUNTRY = 10_000.0, 10.0, 18.0, 45.0, -60.0
#: Column weights of the bounded search and of the conversational one.
BOUNDED_WEIGHTS = {"code": 3.0, "title": 10.0, "description": 1.0, "topic": 2.0, "keywords": 3.0, "aliases": 2.0}
SPOKEN_WEIGHTS = {"code": 3.0, "title": 10.0, "description": 1.0, "topic": 3.0, "keywords": 2.0, "aliases": 2.0}
CODE_LIKE = r"^[A-Za-z0-9][A-Za-z0-9._:\-]{2,}$"
BUCKETS = 64


@dataclass(frozen=True)
class Limits:
    """How much of a long description (in tokens) and of a list (in items) is searched; None is all of it."""

    description: int | None = DESCRIPTION_TOKENS
    items: int | None = 12


WHOLE = Limits(None, None)


def index_tokens(text: Column, stop: tuple[str, ...] = INDEX_STOP) -> Column:
    """Runs of ASCII letters and digits in lower case, of two characters at least, without words that say nothing."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


@dataclass(frozen=True)
class Index:
    """``posts(bucket, term, key, length, weight)``, a term once for each field; ``rows(key, provider, topic, code, plain, words, length)``; sizes."""

    posts: DataFrame
    rows: DataFrame
    documents: int
    average: float


def _described(catalog: DataFrame, key: str, limits: Limits = Limits(), counted: bool = False) -> DataFrame:
    """Each row's identity, its folded title and the title's words, and its weighted tokens (``t``): all, or ``counted``, each once a field."""
    parts = {f: index_tokens(_text(catalog, f, limits.items)) for f in FIELD_WEIGHTS}
    if limits.description is not None:
        parts["description"] = F.slice(parts["description"], 1, limits.description)
    once = lambda t, w: F.transform(fulltext.counted(t, F.lit(0)), lambda x: F.struct(x["term"].alias("term"), (x["n"] * w).alias("weight")))
    weighted = once if counted else lambda t, w: F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(w).alias("weight")))
    each = F.concat(*(weighted(t, FIELD_WEIGHTS[f]) for f, t in parts.items()))
    title = F.coalesce(_text(catalog, "title"), F.lit(""))
    rows = catalog.select(F.col(key).alias("key"), *(F.coalesce(_text(catalog, c), F.lit("")).alias(c) for c in ("provider", "topic", "code")), fold(title, detect_language(title)).alias("plain"), each.alias("t"))
    return rows.withColumn("words", F.array_distinct(index_tokens(F.col("plain")))).withColumn("length", F.size(F.array_distinct("t.term")))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(bucket, term, key, length, weight) of described rows; only of ``terms``, taken out before the rows are exploded."""
    t = F.col("t") if terms is None else F.filter("t", lambda x: x["term"].isin(terms))
    flat = rows.select("key", "length", F.explode(t).alias("t"))
    return flat.groupBy("key", "length", F.col("t.term").alias("term")).agg(F.sum("t.weight").alias("weight")).withColumn("bucket", _bucket(F.col("term")))


def build_index(catalog: DataFrame, path: str, key: str = "id", limits: Limits = WHOLE) -> None:
    """Write postings, partitioned by bucket of term and sorted in it, and rows below ``path``; whole texts unless ``limits`` says less.

    A row's words are counted inside the row, for each field, so the one shuffle is that by bucket; the bucket itself is not shuffled.
    """
    rows = keep(_described(catalog, key, limits, counted=True), "described", compression="zstd")
    rows.drop("t").write.mode("overwrite").parquet(f"{path}/rows", compression="zstd")
    posts = rows.select("key", "length", F.inline("t")).repartition(_bucket(F.col("term"))).withColumn("bucket", _bucket(F.col("term")))
    posts.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings", compression="zstd")


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index; its sizes come from the rows, by one aggregate."""
    rows = spark.read.parquet(f"{path}/rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).first()
    return Index(spark.read.parquet(f"{path}/postings"), rows, size.n, float(size.average or 0.0))


def _hits(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms, with the weights of all fields together: whole buckets are pruned by partition, terms by statistics."""
    buckets = [r[0] for r in index.rows.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()] if terms else []
    posts = index.posts.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)) if terms else index.posts.filter("false")
    return posts.groupBy("key", "length", "term").agg(F.sum("weight").alias("weight"))


def index_of(catalog: DataFrame, key: str = "id", limits: Limits = Limits()) -> tuple[DataFrame, int, float]:
    """Described rows, their number and mean length, by one pass without any explode.

    The rows are written to the shared folder, as sizes, postings and ranking each read them; nothing stays in
    the executors' memory. A catalogue that is searched more than once is better stored by ``build_index``.
    """
    rows = keep(_described(catalog, key, limits), "described")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).first()
    return rows, size.n, float(size.average or 0.0)


def bm25(hits: DataFrame, documents: int, average: float) -> DataFrame:
    """(key, bm25) over postings of the terms (key, length, term, weight)."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("weight") + K1 * (1 - B + B * F.greatest(F.col("length"), F.lit(1)) / (average or 1.0))
    return hits.join(df, "term").groupBy("key").agg(F.sum(idf * F.col("weight") * (K1 + 1) / norm).alias("bm25"))


def bm25_scores(catalog: DataFrame, terms: list[str], key: str = "id", limits: Limits = Limits()) -> DataFrame:
    """(key, bm25) of a catalogue without a stored index."""
    rows, documents, average = index_of(catalog, key, limits)
    return bm25(postings(rows, terms), documents, average)


#: What a request names: concepts in order, each (key, English names, the canonical one first).
Concepts = list[tuple[str, list[str]]]


def _on_driver(spark: SparkSession, *texts: Column) -> list:
    return list(spark.range(1).select(*(t.alias(f"c{i}") for i, t in enumerate(texts))).first())


def search(catalog: DataFrame | Index, query: str, limit: int = 20, providers: list[str] | None = None, topic: str | None = None, key: str = "id", language: str | None = None, concepts: Concepts | None = None, limits: Limits = Limits()) -> DataFrame:
    """(key, score), best first; ties to the smaller key.

    Field-weighted BM25 of the folded query; 1000 for the code itself; 40 / (rank + 1) for titles
    that hold a name of one of the first four concepts; and, where title words are covered, 60 for the
    square of the share, 90 for the whole phrase (70 more at the start), 12 / (1 + words). A query
    none of whose words is in the catalogue (in French or Arabic, say) is replaced by the canonical
    English names of its first two concepts.
    """
    index = catalog if isinstance(catalog, Index) else None
    spark, given = (index.rows if index else catalog).sparkSession, F.lit(query)
    plain, terms = _on_driver(spark, fold(given, F.lit(language) if language else detect_language(given)), index_tokens(fold(given, F.lit(language) if language else detect_language(given))))
    if not query.strip():
        return (index.rows if index else _described(catalog, key)).select(F.col("key").alias(key), F.lit(0.0).alias("score")).filter("false")
    named = [(k, [n for n in names if n.isascii()]) for k, names in (concepts or [])]
    rows, documents, average = (index.rows, index.documents, index.average) if index else index_of(catalog, key, limits)
    find = lambda terms: _hits(index, terms) if index else postings(rows, terms)
    hits = find(sorted(set(terms)))
    if named and (not terms or hits.isEmpty()):
        english = " ".join(names[0] if names else k for k, names in named[:2])
        plain, terms = _on_driver(spark, fold(F.lit(english), F.lit("en")), index_tokens(fold(F.lit(english), F.lit("en"))))
        hits = find(sorted(set(terms)))
    terms = sorted(set(terms))
    covered = F.size(F.array_intersect("words", F.array(*map(F.lit, terms)).cast("array<string>"))) / max(len(terms), 1)
    phrase = F.col("plain").contains(plain) if plain else F.lit(False)
    title = F.when(covered > 0, COVERAGE * covered * covered + F.when(phrase, PHRASE + F.when(F.col("plain").startswith(plain), PREFIX).otherwise(0.0)).otherwise(0.0) + SHORT / (1 + F.size("words"))).otherwise(0.0)
    exact = F.when((F.lower("code") == query.strip().lower()) & F.lit(query.strip()).rlike(CODE_LIKE), CODE_BONUS)
    meant = F.lit(None).cast("double")
    for rank, (k, names) in enumerate(named[:4]):
        folded = [r[0] for r in spark.createDataFrame([(n,) for n in names] or [(k,)], "n string").select(fold(F.col("n"), F.lit("en"))).collect()]
        inside = reduce(lambda a, b: a | b, (F.concat(F.lit(" "), "plain", F.lit(" ")).contains(f" {n} ") for n in folded if n), F.lit(False))
        meant = F.when(inside, F.coalesce(meant, F.lit(0.0)) + CONCEPT / (rank + 1)).otherwise(meant)
    pool = rows.select("key", "provider", "topic", "plain", "words", exact.alias("exact"), meant.alias("meant"))
    pool = pool.filter(F.lower("provider").isin([p.lower() for p in providers])) if providers else pool
    pool = pool.filter(F.lower("topic") == topic.lower()) if topic else pool
    found = pool.join(bm25(hits, documents, average), "key", "left").filter("bm25 is not null or exact is not null or meant is not null")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    score = none("exact") + none("meant") + none("bm25") + (title if terms else F.lit(0.0))
    return found.select(F.col("key").alias(key), F.round(score, 4).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def _prefix_scored(catalog: DataFrame, words: list[str], weights: dict[str, float], match_all: bool, key: str) -> DataFrame:
    """(key, bm25): column-weighted BM25 where each word matches all tokens that start with it.

    The weight of a word is that of the logarithm of odds, and at least a millionth.
    """
    parts = {f: F.regexp_extract_all(F.lower(unmarked(F.coalesce(_text(catalog, f), F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1) for f in weights}
    words = sorted(set(words))
    begin = lambda t, w: F.size(F.filter(t, lambda x: x.startswith(w)))
    f = F.array(*(sum((begin(t, w) * weights[n] for n, t in parts.items()), F.lit(0.0)) for w in words)) if words else F.array().cast("array<double>")
    rows = catalog.select(F.col(key).alias("key"), f.alias("f"), sum((F.size(t) for t in parts.values()), F.lit(0)).alias("d"))
    size = rows.agg(F.count(F.lit(1)), F.avg("d"), *(F.count_if(F.get("f", F.lit(i)) > 0) for i in range(len(words)))).first()
    n, average = size[0], float(size[1] or 1.0)
    idf = [max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) for df in size[2:]]
    share = lambda i: F.get("f", F.lit(i)) * (PREFIX_K1 + 1) / (F.get("f", F.lit(i)) + PREFIX_K1 * (1 - PREFIX_B + PREFIX_B * F.col("d") / average))
    score = sum((idf[i] * share(i) for i in range(len(words))), F.lit(0.0))
    every = F.forall if match_all else F.exists
    return rows.filter(every("f", lambda x: x > 0)).select("key", score.alias("bm25")) if words else rows.select("key", F.lit(0.0).alias("bm25")).filter("false")


def bounded_search(catalog: DataFrame | TextIndex, query: str, limit: int = 20, providers: list[str] | None = None, topic: str | None = None, key: str = "id", language: str | None = None, concepts: Concepts | None = None, places: list[str] | None = None) -> DataFrame:
    """(key, score) of at most ``max(5 limit, 40)`` candidates by prefix-matched BM25, reordered by bonuses.

    Exact codes stand in a band of their own (10,000). To ten times the BM25 come the title's bonuses as
    in ``search``; 18 for each of up to three title words that only other names of the concepts hold;
    and, for titles that name a country, 45 where the request names it too and -60 where not.
    ``places`` are the words of countries and regions; they, and years, do not retrieve anything. A stored
    index reads only the blocks of the request's prefixes.
    """
    spark, raw = catalog.spark if isinstance(catalog, TextIndex) else catalog.sparkSession, query.strip()
    given = fold(F.lit(query), F.lit(language) if language else detect_language(F.lit(query)))
    terms = _on_driver(spark, index_tokens(given, BOUNDED_STOP))[0]
    said, places, context = set(terms), set(places or []), set()
    if concepts:
        split = lambda t: _on_driver(spark, index_tokens(fold(F.lit(t), F.lit("en")), BOUNDED_STOP))[0]
        english = split(" ".join(names[0] if names else k for k, names in concepts[:2]))
        context = {w for _, names in concepts[:2] for n in names[1:] for w in split(n)}
        if english:
            terms = english + [t for t in terms if t not in english and not t.isdigit() and t not in places]
    inside = (F.col("provider").isin(providers) if providers else F.lit(True)) & (F.lower("topic") == topic.lower() if topic else F.lit(True))
    most, code_like = max(5 * limit, 40), bool(re.match(CODE_LIKE, raw))
    if isinstance(catalog, TextIndex):
        first = fulltext.scored(catalog, terms, BOUNDED_WEIGHTS, False).filter(inside).orderBy(F.desc("bm25"), "key").limit(most).select("key", "bm25")
        best = first.collect()  # ``most`` candidates
        first = spark.createDataFrame(best, first.schema)
        titles = catalog.rows([r.key for r in best]).select("key", "plain")
        exact = fulltext.with_code(catalog, raw) if code_like else first.select("key").filter("false")
    else:
        scored = _prefix_scored(catalog, terms, {w: v for w, v in BOUNDED_WEIGHTS.items() if w in catalog.columns}, False, key)
        first = scored.join(catalog.filter(inside).select(F.col(key).alias("key")), "key", "left_semi").orderBy(F.desc("bm25"), "key").limit(most)
        titles = catalog.select(F.col(key).alias("key"), fold(F.coalesce("title", F.lit("")), F.lit("en")).alias("plain"))
        exact = catalog.filter((F.lower("code") == raw.lower()) & F.lit(code_like)).select(F.col(key).alias("key"))
    exact = exact.orderBy("key").limit(5)
    rows = first.join(titles, "key").withColumn("words", F.array_distinct(index_tokens(F.col("plain"), BOUNDED_STOP)))
    lists = lambda x: F.array(*map(F.lit, sorted(x))).cast("array<string>")
    shared = lambda x: F.size(F.array_intersect("words", lists(x)))
    covered, phrase = shared(set(terms)) / max(len(set(terms)), 1), " ".join(terms)
    named = F.when(F.col("plain").contains(phrase), PHRASE + F.when(F.col("plain").startswith(phrase), PREFIX).otherwise(0.0)).otherwise(0.0) if phrase else F.lit(0.0)
    score = F.col("bm25") * BOUNDED_SCALE + F.when(covered > 0, COVERAGE * covered * covered + named + SHORT / (1 + F.size("words"))).otherwise(0.0)
    score = score + ALIAS_OVERLAP * F.least(shared(context - set(terms)), F.lit(3))
    score = score + F.when(shared(places & said) > 0, SAME_COUNTRY).when(shared(places) > 0, OTHER_COUNTRY).otherwise(0.0)
    out = exact.select("key", F.lit(CODE_BAND).alias("score")).unionByName(rows.join(exact, "key", "left_anti").select("key", F.round(score, 4).alias("score")))
    return out.orderBy(F.desc("score"), "key").limit(limit).withColumnRenamed("key", key)


#: What makes a word its opposite.
NEGATIONS = ("un", "non", "dis", "in")


def spoken_search(catalog: DataFrame | TextIndex, query: str, limit: int = 20, provider: str | None = None, topic: str | None = None, key: str = "id") -> DataFrame:
    """(key, relevance), smaller is better: all words must match by prefix; BM25 less 0.05 for each point of popularity.

    One-word queries, unless they are negations themselves, put 50 on titles without the word
    as a word of its own, among three times as many candidates.
    """
    stored = isinstance(catalog, TextIndex)
    words = _on_driver(catalog.spark if stored else catalog.sparkSession, F.regexp_extract_all(F.lower(F.lit(query)), F.lit(r"([\p{L}\p{N}_]+)"), 1))[0]
    if stored:
        rows = fulltext.scored(catalog, words, SPOKEN_WEIGHTS, True)
    else:
        popular = F.coalesce(F.col("popularity").cast("double"), F.lit(0.0)) if "popularity" in catalog.columns else F.lit(0.0)
        scored = _prefix_scored(catalog, words, {w: v for w, v in SPOKEN_WEIGHTS.items() if w in catalog.columns}, True, key)
        rows = scored.join(catalog.select(F.col(key).alias("key"), "title", "provider", "topic", popular.alias("popularity")), "key")
    rows = rows.filter(F.lower("provider") == provider.lower()) if provider else rows
    rows = rows.filter(F.col("topic") == topic) if topic else rows
    rows = rows.withColumn("relevance", -F.col("bm25") - 0.05 * F.col("popularity"))
    if len(words) == 1:
        rows = rows.orderBy("relevance", "key").limit(3 * limit)
        if not words[0].startswith(NEGATIONS):
            if stored:
                best = rows.select("key", "relevance").collect()  # three times ``limit``
                rows = rows.sparkSession.createDataFrame(best, rows.select("key", "relevance").schema).join(catalog.rows([r.key for r in best]).select("key", "title"), "key")
            alone = F.lower(F.coalesce("title", F.lit(""))).rlike(rf"\b{words[0]}")
            rows = rows.withColumn("relevance", F.col("relevance") + F.when(alone, 0.0).otherwise(50.0))
    return rows.select(F.col("key").alias(key), F.round("relevance", 4).alias("relevance")).orderBy("relevance", key).limit(limit)


def prefix_search(catalog: DataFrame | TextIndex, words: list[str], match_all: bool, limit: int, key: str = "id", provider: str | None = None) -> DataFrame:
    """(key, bm25) of rows (of a provider) with tokens that start with all (or any) of the words, best first."""
    if isinstance(catalog, TextIndex):
        scored = fulltext.scored(catalog, words, SPOKEN_WEIGHTS, match_all, provider)
    else:
        mine = catalog.filter(F.lower("provider") == provider.lower()) if provider else catalog
        scored = _prefix_scored(mine, words, {w: v for w, v in SPOKEN_WEIGHTS.items() if w in catalog.columns}, match_all, key)
    return scored.select(F.col("key").alias(key), F.round("bm25", 4).alias("bm25")).orderBy(F.desc("bm25"), key).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles; null if one is all zeros."""
    dot = lambda x, y: F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), F.lit(0.0), lambda s, p: s + p["x"].cast("double") * p["y"].cast("double"))
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def vector_top(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", keep: Column | None = None) -> DataFrame:
    """The k rows of highest positive cosine; ties to the smaller key. A mask goes before the scores."""
    rows = vectors if keep is None else vectors.filter(keep)
    score = cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return rows.select(key, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, score: str = "score", k: int = 60, cut: int = 20) -> DataFrame:
    """(key, rrf): sum of 1 / (k + rank + 1) over the lists, ranks from 0, each list cut."""
    parts = None
    for one in lists:
        top = one.orderBy(F.desc(score), key).limit(cut)
        part = top.select(key, (1.0 / (k + F.row_number().over(Window.orderBy(F.desc(score), key)))).alias("r"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sum("r").alias("rrf"))


def legacy_fusion(vector: DataFrame, lexical: DataFrame, key: str, score: str = "score", cut: int = 20) -> DataFrame:
    """Vector scores with 0.02 / (rank + 1) more for lexical hits; lexical hits alone 0.55 less 0.005 a rank (0.1 at most).

    The lexical list is cut before it is ranked, so that one task ranks at most ``cut`` rows.
    """
    first = lexical.orderBy(F.desc(score), key).limit(cut)
    ranked = first.select(key, (F.row_number().over(Window.orderBy(F.desc(score), key)) - 1).alias("r"))
    both = vector.select(key, F.col(score).alias("v")).join(ranked, key, "full_outer")
    alone = 0.55 - F.least(F.lit(0.1), 0.005 * F.col("r"))
    return both.select(key, F.when(F.col("v").isNull(), alone).otherwise(F.col("v") + F.coalesce(F.try_divide(F.lit(0.02), F.col("r") + 1), F.lit(0.0))).alias("fused"))


def ambiguity(ranked: DataFrame, score: str, fused: bool = True) -> DataFrame:
    """One row: whether the first three scores lie too close together to choose."""
    at = F.row_number().over(Window.orderBy(F.desc(score)))
    top = ranked.orderBy(F.desc(score)).limit(3).withColumn("n", at)
    s1, s3 = F.max(F.when(F.col("n") == 1, F.col(score))), F.max(F.when(F.col("n") == 3, F.col(score)))
    close = (s1 - s3) < (s1 * 0.05 if fused else F.lit(0.03))
    return top.agg(s1.alias("first"), s3.alias("third"), F.coalesce(close, F.lit(False)).alias("ambiguous"))


def best_series(hits: DataFrame, priority: str, score: str = "score", key: str = "id") -> DataFrame:
    """The hit of highest score, then provider priority; its confidence; and the next three."""
    w = Window.orderBy(F.desc(score), F.asc(priority), key)
    top = hits.orderBy(F.desc(score), F.asc(priority), key).limit(4).withColumn("place", F.row_number().over(w))
    confidence = F.least(F.lit(0.94), 0.55 + 0.4 * F.coalesce(F.try_divide(F.col(score), F.max(score).over(Window.partitionBy())), F.lit(0.0)))
    return top.withColumn("confidence", F.when(F.col("place") == 1, confidence))


def meaning_tokens(text: Column) -> Column:
    """Words and their simple singulars, as a set."""
    found = F.filter(F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" "))), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 1)
    one = lambda t: F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y"))).when(t.endswith("s") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.array_distinct(F.concat(found, F.transform(found, one)))


def concept_by_synonym(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term, key, confidence): the best concept of ``concepts(key, place, synonyms array<string>)`` for each ``terms(term)``.

    Exact 1; a synonym of four letters inside the term .95 and up to .03 more by its words; from 60 % of two
    words or more .56 + .4 of the share, .92 at most; one whole word .84. Where the term names imports or
    exports, synonyms of the same direction gain .10, of the other lose .35 and neutral ones .12.
    Accepted from .72; ties to the smaller place. Concepts are few: they are checked to fit and broadcast.
    """
    few = concepts.limit(10_001).count() <= 10_000
    flat = concepts.select("key", "place", F.explode(F.concat(F.array(F.replace("key", F.lit("_"), F.lit(" "))), "synonyms")).alias("name")).withColumn("name", F.lower(F.trim("name"))).filter("name <> ''").withColumn("have", meaning_tokens(F.col("name")))
    asked = terms.select("term").distinct().withColumn("low", F.lower(F.trim("term"))).withColumn("want", meaning_tokens(F.col("low")))
    pairs = asked.filter("size(want) > 0").withColumn("w", F.explode("want")).join((F.broadcast if few else lambda x: x)(flat.withColumn("w", F.explode("have"))), "w").drop("w").distinct()
    share = F.size(F.array_intersect("want", "have")) / F.size("have")
    base = F.when((F.size("have") >= 2) & (share >= 0.6), F.least(F.lit(0.92), 0.56 + 0.4 * share)).when((F.size("have") == 1) & (share >= 1), 0.84).otherwise(0.0)
    names = lambda c, x: F.arrays_overlap(c, F.array(F.lit(x), F.lit(f"{x}s")))
    for way, other in (("import", "export"), ("export", "import")):
        base = base + F.when(names(F.col("want"), way), F.when(names(F.col("have"), way), 0.10).when(names(F.col("have"), other), -0.35).otherwise(-0.12)).otherwise(0.0)
    inside = (F.length("name") >= 4) & F.col("low").contains(F.col("name"))
    score = F.when(F.col("low") == F.col("name"), 1.0).when(inside, 0.95 + F.least(F.lit(0.03), 0.01 * F.greatest(F.size("have") - 1, F.lit(0)))).otherwise(base)
    best = pairs.withColumn("score", score).groupBy("term").agg(F.max_by(F.struct("key", "score"), F.struct("score", -F.col("place"))).alias("b"))
    return best.select("term", "b.key", F.round("b.score", 6).alias("confidence")).filter("confidence >= 0.72")


def tag_titles(titles: DataFrame, phrases: DataFrame, key: str = "id", longest: int | None = None) -> DataFrame:
    """(key, concept) where a title holds a phrase, by an equi-join on word n-grams instead of ``contains``.

    N-grams are as long as the longest phrase given, so none is out of reach.
    """
    split = lambda c: tokens(c, stop=("\u0000",), least=1)
    wanted = phrases.select(F.array_join(split(F.col("phrase")), " ").alias("phrase"), F.size(split(F.col("phrase"))).alias("n"), "concept")
    most = longest or wanted.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    rows = titles.select(key, split(F.col("title")).alias("w")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(max(1, most)))))
    grams = rows.filter("size(w) >= n").select(key, F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("phrase"))
    return grams.join(wanted.drop("n"), "phrase").select(key, "concept").distinct()


def title_match(a: Column, b: Column) -> Column:
    """exact, close or none, for two token lists."""
    same = F.size(F.array_intersect(a, b))
    delta = F.abs(F.size(a) - F.size(b))
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    suffix = (F.size(short) >= 3) & (delta <= 1) & (F.slice(long_, F.greatest(F.size(long_) - F.size(short) + 1, F.lit(1)), F.size(short)) == short)
    overlap = same / F.greatest(F.size(F.array_distinct(short)), F.lit(1))
    symmetric = same / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    close = suffix | ((F.size(short) >= 5) & (delta <= 2) & (overlap >= 0.85) & (symmetric >= 0.70))
    return F.when(a == b, "exact").when(close, "close").otherwise("none")


def _bag(tokens: str | Column) -> Column:
    """A title's tokens in order: equal for titles that are permutations of each other."""
    return F.array_sort(tokens)


def _near_bags(bags: DataFrame) -> DataFrame:
    """(e, near): distinct bags that differ by one token, each pair once.

    A bag is near another if one token less makes it the other, or if both without one token are equal and
    so long that what they share is 92 % of them (13 tokens and more). So bags meet by the hash of what is
    left, only near ones meet, and what meets is compared whole.
    """
    rows = bags.select("e", F.size("e").alias("n"))
    less = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.xxhash64(F.concat(F.slice("e", 1, i - 1), F.slice("e", i + 1, F.col("n")))))
    cut = rows.select("e", "n", F.explode(F.array_distinct(less)).alias("h"))
    whole = rows.select(F.col("e").alias("near"), (F.col("n") + 1).alias("n"), F.xxhash64("e").alias("h"))
    long_ = cut.filter((F.col("n") - 1) / F.col("n") >= 0.92)
    other = long_.select(F.col("e").alias("near"), "n", "h")
    met = cut.join(whole, ["n", "h"]).unionByName(long_.join(other, ["n", "h"]).filter(F.col("e") < F.col("near")))
    numbered = lambda c: F.expr(f"transform({c}, (t, i) -> concat(t, '\u0001', i + 1 - array_position({c}, t)))")
    common, large = F.size(F.array_intersect(numbered("e"), numbered("near"))), F.greatest(F.size("e"), F.size("near"))
    return met.filter(large - common <= 1).select("e", "near").distinct()


def permuted_titles(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """(left, right): titles (key, tokens) of five tokens and more that differ by at most one token of a multiset, in any order.

    Every pair is a row, those of copies too; ``permuted_classes`` gives classes of copies instead.
    """
    each = lambda t, name: t.filter("size(tokens) >= 5").select(F.col(key).alias(name), _bag("tokens").alias("e"))
    left, right = each(a, "left"), each(b, "right")
    bags = left.select("e").unionByName(right.select("e")).distinct()
    near = _near_bags(bags)
    links = bags.select("e", F.col("e").alias("near")).unionByName(near).unionByName(near.select(F.col("near").alias("e"), F.col("e").alias("near")))
    return left.join(links, "e").select("left", F.col("near").alias("e")).join(right, "e").select("left", "right").distinct()


def permuted_classes(titles: DataFrame, key: str = "id") -> DataFrame:
    """(kind, left, right): the links of ``permuted_titles`` within one table, by classes of permutations.

    A class goes by its smallest key. ``member`` rows give each title (right) its class (left), ``near`` rows the pairs of
    classes that differ by one token, the smaller first; two titles are linked when their classes are equal or near.
    """
    rows = titles.filter("size(tokens) >= 5").select(F.col(key).alias("right"), _bag("tokens").alias("e")).distinct()
    classes = rows.groupBy("e").agg(F.min("right").alias("left"))
    member = rows.join(classes, "e").select(F.lit("member").alias("kind"), "left", "right")
    one, other = classes.withColumnRenamed("left", "one"), classes.select(F.col("e").alias("near"), F.col("left").alias("other"))
    near = _near_bags(classes).join(one, "e").join(other, "near")
    return member.unionByName(near.select(F.lit("near").alias("kind"), F.least("one", "other").alias("left"), F.greatest("one", "other").alias("right")))


def ranking_quality(results: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """recall@k, mean reciprocal rank and number of (query, rank of the right answer or null), in all or by group."""
    within = F.col("rank") <= k
    return results.groupBy(*(by or [])).agg(F.avg(F.when(within, 1.0).otherwise(0.0)).alias("recall_at_k"), F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("rank")), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("queries"))


def catalogue_counts(catalog: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Series by (column, what stands for an empty one), one or several."""
    names = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(empty)).alias(c) for c, empty in columns]
    return catalog.groupBy(*names).agg(F.count(F.lit(1)).alias("series"))


def catalogue_stats(catalog: DataFrame, now: Column | None = None) -> DataFrame:
    """Series, providers, the last update, those of 30 days, and the milestone reached."""
    n = F.count(F.lit(1))
    when = F.to_timestamp("last_updated")
    recent = F.count_if(when >= F.coalesce(now if now is not None else F.current_timestamp()) - F.expr("INTERVAL 30 DAYS"))
    band = F.when(n >= 1_000_000, "1M").when(n >= 500_000, "500k").when(n >= 331_000, "331k").otherwise("below")
    return catalog.agg(n.alias("series"), F.countDistinct("provider").alias("providers"), F.max(when).alias("latest"), recent.alias("recent"), band.alias("milestone"))


def build_catalogue(raw: DataFrame, order: str, upsert: bool = False, characters: int | None = 4000, aliases: int | None = 12) -> DataFrame:
    """One row for each (provider, code): the first to come, or with ``upsert`` the last. Descriptions keep so many
    characters and lists so many aliases; None keeps all."""
    w = Window.partitionBy("provider", "code").orderBy(F.desc(order) if upsert else F.asc(order))
    rows = raw.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    rows = rows.withColumn("description", F.substring("description", 1, characters)) if "description" in raw.columns and characters is not None else rows
    return rows.withColumn("aliases", F.slice("aliases", 1, aliases)) if "aliases" in raw.columns and aliases is not None else rows


def related_series(catalog: DataFrame | TextIndex, name: str, provider: str, key: str = "id", limit: int = 5) -> DataFrame:
    """Up to five rows of the provider that match all of the first four words of a name (its part before
    a comma or parenthesis); any of them where none has all."""
    head = re.split(r"[,(]", name)[0]
    words = [w for w in re.findall(r"\w+", head.lower()) if len(w) > 1][:4]
    found = prefix_search(catalog, words, True, limit, key, provider)
    return prefix_search(catalog, words, False, limit, key, provider) if found.isEmpty() else found


#: Cues of what a series measures, and how much a series without a cue that was asked for loses.
CUES = {"import": r"\bimports?\b", "export": r"\bexports?\b", "trade_balance": r"\b(?:trade balance|net exports)\b", "current_account": r"\bcurrent account\b", "exchange_rate": r"\bexchange rate\b", "money_supply": r"\b(?:money supply|broad money|m[123])\b", "policy_rate": r"\bpolicy rate\b", "house_prices": r"\b(?:house|property) prices?\b", "credit": r"\bcredit\b", "reserves": r"\breserves\b", "discontinued": r"\bdiscontinued\b"}
LACKING = {"import": 2.2, "export": 2.2, "trade_balance": 2.2, "current_account": 2.6, "exchange_rate": 1.8, "money_supply": 2.2, "policy_rate": 2.0, "house_prices": 2.2, "credit": 1.8, "reserves": 2.0}
RATIO = r"% of gdp|percent(?:age)? of gdp|share of gdp|to gdp ratio|ratio to gdp"


def relevance(query: str, series: Column, cues: dict[str, str] = CUES, lacking: dict[str, float] = LACKING) -> Column:
    """How well a series' text fits a request, by cues, shared words and ratios.

    2.5 for each shared cue, -2 if the request has some and none is shared; what ``lacking`` says for
    each that the series lacks; .35 for each shared word up to 2.5; ratios of GDP 2.5 or -1.8; -3 for
    discontinued series that were not asked for; -1 for an empty text. Cues are a parameter.
    """
    low = F.lower(F.coalesce(series, F.lit("")))
    asked = [c for c, p in cues.items() if re.search(p, query.lower())]
    has = {c: low.rlike(p) for c, p in cues.items()}
    shared = sum((has[c].cast("int") for c in asked), F.lit(0))
    words = sorted({w for w in re.findall(r"[a-z0-9]+", query.lower()) if len(w) > 2} - set(INDEX_STOP))
    both = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)), F.array(*map(F.lit, words)).cast("array<string>")))
    score = shared * 2.5 + (F.when(shared == 0, -2.0).otherwise(0.0) if asked else F.lit(0.0)) + F.least(F.lit(2.5), both * 0.35)
    for c in asked:
        score = score - F.when(has[c], 0.0).otherwise(lacking.get(c, 0.0))
    if re.search(RATIO, query.lower()):
        score = score + F.when(low.rlike(RATIO), 2.5).otherwise(-1.8)
    if "discontinued" in cues and "discontinued" not in asked:
        score = score - F.when(has["discontinued"], 3.0).otherwise(0.0)
    return F.when(low == "", -1.0).otherwise(score)


def keep_relevant(hits: DataFrame, score: str = "score", several: bool = False) -> DataFrame:
    """Hits within 3 of the best, if that is at least .8; all of them for requests of several indicators."""
    if several:
        return hits
    top = hits.agg(F.max(score)).first()[0]  # one number
    return hits if top is None or top < 0.8 else hits.filter(F.col(score) >= max(0.0, top - 3))

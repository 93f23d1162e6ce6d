"""Importance resampling, spelling variants, the multi-index: against brute force, and the odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from almanack.llm import multiindex, resample, spelling, textcore

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_crc_of_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 2500, 200))
    ends = starts + rng.integers(0, 400, 200)
    before = rng.integers(0, 1 << 32, 200).astype(np.uint32)
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert textcore.crc32(data, starts, ends).tolist() == [zlib.crc32(s) for s in spans]
    assert textcore.crc32(data, starts, ends, before).tolist() == [zlib.crc32(s, int(v)) for s, v in zip(spans, before)]
    assert textcore.crc32_bytes(32, before).tolist() == [zlib.crc32(b" ", int(v)) for v in before]
    none = np.zeros(0, dtype=np.int64)
    assert textcore.crc32(data, none, none).tolist() == []


# importance resampling


def drawn(docs, target, config):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % config.buckets for n in range(1, config.ngrams + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    every, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every + config.buckets) / ((s[b] + 1) * (wanted + config.buckets))))
    rows = []
    for i, x in docs:
        n, found = features(x)
        h = int(hashlib.sha256(f"{config.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= config.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(able[: config.percent * len(able) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("ngrams", [1, 3])
def test_draw_agrees_with_sorting_all(spark, ngrams):
    rng = random.Random(ngrams)
    words = ["Alpha", "beta", "gamma", "été", "日本", "x1", "delta-eps", "ZETA"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(None, "alpha beta gamma delta"), (None, None), (1000, None), (1001, ""), (1002, "\n\t--"), (1003, "beta " * 40_000), (1004, "q" * 70_000)]
    docs += [(7, docs[7][1])] * 150 + [(8, "alpha"), (8, "alpha beta gamma")]  # repeated rows, repeated ids
    target = ["gamma été gamma", None, "", "beta " * 50]
    config = resample.ResampleConfig(ngrams=ngrams, buckets=61, min_words=3, percent=40, pivots=3)
    df = spark.createDataFrame([(i, x, 1.0, "n") for i, x in docs], "doc_id long, text string, score double, rank string").repartition(5)
    got = resample.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), config=config)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == drawn(docs, target, config)
    kept = resample.drawn_documents(df, got)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.filter("rank is not null and doc_id is not null").collect()}


def test_draw_from_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    one = resample.resample(some, none).first()
    assert one.rank is None and one.n_features == 27
    assert resample.resample(some, none, config=resample.ResampleConfig(percent=100)).first()["rank"] == 1


def test_quickselect_finds_every_place(spark):
    scores = [5, 5, 5, 4, 4, 3, 3, 3, 3, 3, 2, -1, -1, None]
    df = spark.createDataFrame([(i % 3, s or 0, 1) for i, s in enumerate(scores)], "doc_id long, score long, n_features long").withColumn("key", resample.composite_key("doc_id"))
    expected = sorted((-(s or 0), i % 3) for i, s in enumerate(scores))
    for k in range(1, len(scores) + 1):
        key = spark.range(1).select(resample.kth_key(df.select("key"), k, resample.ResampleConfig(pivots=2)).alias("k")).first().k
        assert (key.s, key.id) == expected[k - 1]
    assert resample.kth_key(df.select("key"), len(scores) + 1) is None


# spelling variants


def slow_variants(docs, config):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if config.noise and h % config.noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= config.letters:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= config.least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= config.ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize(("noise", "block"), [(0, 20_000), (5, 20_000), (3, 1)])
def test_variants_agree_with_all_pairs(spark, noise, block):
    rng = random.Random(noise)
    alphabet = "abceéÉÿ×Zq"
    base = ["".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(90)]
    base += [w[:i] + rng.choice(alphabet) + w[i + (k := rng.random() < 0.5) :] for w in base for i in [rng.randrange(len(w))]]
    base += ["aaaaaa", "aaaaa", "aaaa", "a" * 300, "a" * 299, "b" + "a" * 299]
    docs = [(i, rng.choice([" ", "1", "-", "\n"]).join(rng.choices(base, k=rng.randint(0, 60), weights=[1 / (r % 17 + 1) ** 2 for r in range(len(base))]))) for i in range(120)]
    docs += [(None, "aaaaaa aaaaaa"), (500, None), (501, ""), (502, "aaaa " * 20_000), (3, docs[3][1]), (3, docs[3][1])]
    # A block of 1 divides every part with more than one word, so that questions meet several divisions.
    config = spelling.SpellingConfig(letters=4, least=2, ratio=2, noise=noise, groups=4, block=block, pairs=50)
    df = spark.createDataFrame([(i, x, "w") for i, x in docs], "doc_id long, text string, word string").repartition(4)
    got = [tuple(r) for r in spelling.variants(df, config=config).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == slow_variants(docs, config)


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(none).collect() == []
    few = spark.createDataFrame([(1, "one word 123")], "doc_id long, text string")
    assert spelling.variants(few).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(few, config=spelling.SpellingConfig(ratio=1))


def test_trie_reaches_what_the_budget_allows():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (200, 5))
    trie = spelling.Trie(counts)
    for surplus, deficit in [(0, 0), (1, 0), (0, 1), (1, 1)]:
        found = defaultdict(set)
        n = len(counts)
        for q, leaf in trie.search(counts, np.full(n, surplus), np.full(n, deficit), 37):
            for a, b in zip(q.tolist(), leaf.tolist()):
                found[a] |= set(trie.order[trie.first[b] : trie.first[b + 1]].tolist())
        step = counts[None] - counts[:, None]
        more, less = np.where(step > 0, step, 0).sum(axis=2), np.where(step < 0, -step, 0).sum(axis=2)
        assert all(found[a] == set(np.flatnonzero((more[a] <= surplus) & (less[a] <= deficit)).tolist()) for a in range(n))


def test_one_edit_on_arrays():
    words = ["", "a", "b", "ab", "ba", "abc", "acb", "aab", "aaab", "xabc", "abcx", "axbc", "é", "éa"]
    pack = spelling.letters_of(pa.array(words))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    near = lambda a, b: (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1 :] == min(a, b, key=len) for k in range(max(len(a), len(b)))))
    assert spelling.one_edit(pack, i, pack, j).tolist() == [near(words[a], words[b]) for a, b in zip(i, j)]


# the multi-index


def nearest(vectors, dims, k):
    have = {}
    for i, v in vectors:
        if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and any(v):
            have.setdefault(i, set()).add(tuple(float(np.float32(x)) for x in v))
    rows = [(i, v) for i, vs in have.items() for v in vs]
    mat = np.array([v for _, v in rows])
    out = {}
    for i in (i for i in have if i % 10 == 0):
        q = min(have[i])
        score = np.zeros(len(rows))
        for d in range(dims):
            score += mat[:, d] * q[d]
        out[i] = sorted((-s, j) for s, (j, _) in zip(score.tolist(), rows) if j != i)[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(12)]
    out = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(centres)]) for i in range(900)]
    out += [(2000 + i, out[5][1]) for i in range(500)]  # one vector holds a third
    out += [(3000, None), (3010, [0.1, None] + [0.0] * 7), (3020, [math.nan] * 9), (3030, [math.inf] * 9), (None, [0.1] * 9), (3040, [0.5, 0.5]), (3050, [0.0] * 9), (3060, [-0.0] * 8 + [1.0]), (3060, [0.0] * 8 + [1.0])]
    return out + [(10, out[11][1]), (20, out[20][1]), (20, out[20][1])]  # an id with two vectors, a repeated row


def test_multi_index_finds_nearly_all(spark, vectors):
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in vectors], "vec_id long, embedding array<float>, score double, rank int").repartition(5)
    config = multiindex.MultiIndexConfig(k=7, fit_rows=400, entries=4, first=3, block=64, queries=16)
    index = multiindex.build_index(df, config=config)
    assert index.entries < 920  # equal vectors are one entry
    found = defaultdict(list)
    for r in sorted(multiindex.search(index, df.filter("vec_id % 10 = 0"), config=config).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((-r.score, r.vec_id))
    expected = nearest(vectors, 9, 7)
    assert set(found) == set(expected)
    assert all(len(found[i]) == len(expected[i]) and found[i] == sorted(found[i]) for i in expected)
    hits = sum(len(set(found[i]) & set(expected[i])) for i in expected)
    assert hits >= 0.97 * sum(map(len, expected.values()))
    hot = min(i for i in expected if 2000 <= i < 2500)
    assert found[hot] == expected[hot]  # ties to the smaller id, among copies too


def test_multi_index_visits_everything_if_asked(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    config = multiindex.MultiIndexConfig(k=7, entries=30, reach=(50.0, 0.0))
    got = defaultdict(list)
    for r in multiindex.search(multiindex.build_index(df, config=config), df.filter("vec_id % 10 = 0"), config=config).collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert {i: sorted(v) for i, v in got.items()} == nearest(vectors, 9, 7)


def test_multi_index_of_few_vectors(spark):
    shape = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([], shape)
    one = spark.createDataFrame([(0, [1.0]), (20, [0.0])], shape)
    assert multiindex.search(multiindex.build_index(none), one).collect() == []
    assert multiindex.search(multiindex.build_index(one), one).collect() == []
    assert multiindex.search(multiindex.build_index(one), none).collect() == []
    three = spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (2, [1.0])], shape)
    got = multiindex.search(multiindex.build_index(three), three.filter("vec_id = 0"))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, -2.0)]


def test_heap_hands_out_pairs_in_order():
    rng = np.random.default_rng(1)
    one, two = rng.normal(size=7), rng.normal(size=5)
    sizes = rng.integers(0, 4, 35)
    q = multiindex.Quantiser(2, (np.zeros((7, 1)), np.zeros((5, 1))), (one, two), sizes, sizes, sizes)
    close = (one[:, None] + two[None, :]).ravel()
    order = np.argsort(-close)
    held = np.cumsum(sizes[order])
    for wanted in range(1, int(held[-1]) + 1):
        assert q.nearest_pairs(one, two, wanted) == close[order[np.searchsorted(held, wanted)]]
    assert q.nearest_pairs(one, two, int(held[-1]) + 1) == -np.inf


def test_multi_index_of_repeated_runs(spark):
    """The same result whatever the partitions are."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    config = multiindex.MultiIndexConfig(k=3, fit_rows=100, block=50, first=2)
    results = []
    for n in (1, 6):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").orderBy(F.rand(n)).repartition(n)
        results.append({tuple(r) for r in multiindex.search(multiindex.build_index(df, config=config), df.filter("vec_id % 20 = 0"), config=config).collect()})
    assert results[0] == results[1]

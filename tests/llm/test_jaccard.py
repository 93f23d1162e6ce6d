import random
import re

import numpy as np
import pyarrow as pa
import pytest

from almanack.llm import jaccard
from almanack.llm.graph import components
from almanack.llm.jaccard import JaccardConfig, jaccard_components


def shingles(text, width=5):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(docs, percent):
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = say(30)  # a passage that many documents hold
    docs, base = [], say(60)
    for d in range(n):
        kind = d % 4
        if kind == 0:
            w = say(rng.randint(0, 80))
        elif kind == 1:  # near copies of one base, by a few edits
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 2:
            w = shared + say(rng.randint(5, 60))
        else:
            w = (docs[rng.randrange(len(docs))][1] or "").split() + say(rng.choice([0, 0, 1, 3]))
        docs.append((1000 - d, (" " if d % 5 else "\n\t").join(w).upper() if d % 7 == 0 else " ".join(w)))
    return docs


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 80, 256), (2, 80, 3), (3, 90, 8), (4, 60, 4)])
def test_agrees_with_all_pairs(spark, seed, percent, block):
    docs = corpus(seed)
    config = JaccardConfig(percent=percent, query_block=max(1, block // 2), member_block=block, pivots=3, bloom_bits=1 << 27 if seed % 2 else 0)
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), config=config)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, percent)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "a b", 1), (5, "A  b", 1), (6, "a b c", 1), (7, long, 2), (8, long + " tail", 2), (9, "same same", 3), (9, "same same", 4), (None, "a b", 5), (10, " ", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n long").withColumnsRenamed({"n": "component_id"})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29996, 7), (8, 29997, 7), (9, 1, 9), (9, 1, 9), (None, 1, None), (10, 1, 10)], key=repr)
    assert jaccard_components(df.limit(0)).count() == 0


def test_regions_are_divided_without_loss(spark, monkeypatch):
    """One cell with several groups that are far from its pivot and from each other: divided, and no link lost."""
    rng = random.Random(11)
    shared = [f"s{k}" for k in range(5)]
    docs = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(60)]
        for k in range(30):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            docs.append((g * 100 + k, " ".join(shared + w)))

    def no_bounds(batches):  # every pair may link, so nothing is settled by bitmaps
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), pa.array(m), pa.array(np.minimum(n, m))], names=["id", "pivot", "n", "pivot_n", "most"])

    sizes = []
    real = jaccard._voronoi
    monkeypatch.setattr(jaccard, "_voronoi", lambda base, large, level, config: sizes.append((level, large.count())) or real(base, large, level, config))
    monkeypatch.setattr(jaccard, "_frequent", lambda counts, bound: (np.zeros(0, dtype="uint64"), np.zeros(0, dtype="int64")))
    monkeypatch.setattr(jaccard, "_bounds", no_bounds)
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), config=JaccardConfig(query_block=4, member_block=8, pivots=4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, 80)
    assert sizes  # some region was divided


def test_a_repeated_id_joins_what_its_texts_link(spark):
    docs = [(1, "a a1"), (2, "b b1"), (9, "a a1"), (9, "b b1"), (5, "c"), (5, None), (7, "c"), (8, "d"), (8, "e"), (8, "f"), (10, "f"), (11, "e")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 1), (5, 5), (5, 5), (7, 5), (8, 8), (8, 8), (8, 8), (9, 1), (9, 1), (10, 8), (11, 8)]


def test_like_strings_are_different_words(spark):
    s = "a"
    while len(s) < 2048:
        s += s.translate(str.maketrans("ab", "ba"))
    other = s.translate(str.maketrans("ab", "ba"))
    docs = [(1, s), (2, other), (3, s[:1024]), (4, other[:1024])]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (5, 5)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[99] == 99 and got[229] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

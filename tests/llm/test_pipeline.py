import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from almanack.llm import bpe

KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def say(rng, n):
    return " ".join(rng.choice("the of and to in is that with was for".split()) if rng.random() < 0.4 else "".join(rng.choice("abdelmnorst") for _ in range(6)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Documents with an extra column whose name clashes with the operators' own, and the side tables."""
    rng, root = random.Random(9), tmp_path_factory.mktemp("sf")
    item = say(rng, 40)
    texts = {i: say(rng, rng.randint(30, 90)) for i in range(200)}
    junk = {i: " | ".join(say(rng, 40).split()) for i in range(200, 300)}
    rows = [(i, t, "en", f"s{i % 3}", len(t), 0.5) for i, t in (texts | junk).items()]
    rows += [(400 + i, texts[i], "en", "copy", 1, 0.5) for i in range(20)]  # exact copies
    rows += [(430, texts[1] + " tail", "en", "near", 1, 0.5), (440, f"{say(rng, 20)} {item} {say(rng, 20)}", "en", "leak", 1, 0.5), (450, f'{say(rng, 30)} token = "{KEY}" {say(rng, 30)}', "en", "s", 1, 0.5)]
    rows += [(500, None, None, None, None, None), (501, "", "en", "s", 0, 0.5), (None, say(rng, 50), "en", "s", 1, 0.5), (5, texts[5], "en", "s2", len(texts[5]), 0.5), (502, say(rng, 60_000), "en", "s", 1, 0.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i in range(0, 300, 2)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, item


def test_every_stage(spark, world):
    root, rows, item = world
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    got = corpus_pipeline.good_quality(spark, docs, root)
    assert got.schema == docs.schema
    ids = {r.doc_id for r in got.collect()}
    assert len([i for i in range(200) if i in ids]) >= 196 and not [i for i in range(200, 300) if i in ids]

    got = corpus_pipeline.one_of_each_group(spark, docs, root)
    kept = [r.doc_id for r in got.collect()]
    assert got.columns == columns and len(kept) == len(set(kept))
    assert sorted(kept, key=str) == sorted([d for d in {r[0] for r in rows} if not (d and (400 <= d < 420 or d == 430))], key=str)

    got = corpus_pipeline.no_benchmark(spark, docs, root)
    assert got.columns == columns
    left = [r.doc_id for r in got.collect()]
    assert sorted(map(str, left)) == sorted(str(r[0]) for r in rows if item not in (r[1] or ""))

    got = corpus_pipeline.no_secrets(spark, docs, root)
    assert got.columns == columns
    expected = sorted((str(r[0]), str(r[1] and r[1].replace(KEY, "[SECRET]"))) for r in rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == expected

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = corpus_pipeline.tokens(spark, docs, root)
    assert sorted((str(r.doc_id), r.n_tokens, r.token_ids) for r in got.collect()) == sorted((str(r[0]), len(x), x) for r in rows for x in [own.encode_ordinary(r[1] or "")])


def test_empty_tables_pass_through(spark, world):
    root = world[0]
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        assert out.count() == 0
        docs = out if set(docs.columns) <= set(out.columns) else docs


def test_run_applies_all_stages(spark, world):
    root, rows, item = world
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    assert 440 not in out and 430 not in out and 410 not in out and 250 not in out and 450 in out and 502 in out
    assert re.fullmatch("n-gram Jaccard join", corpus_pipeline.STAGES[1][0]) and 4 <= len(corpus_pipeline.STAGES) <= 5

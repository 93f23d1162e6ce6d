"""The registered queries themselves on the smallest tables: against SQL where there is any, else against slow versions."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from almanack.llm import bpe, queries, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def plain(v):
    return float(f"{v:.12g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns, answer = sorted(df.columns), con.execute(queries.ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


def texts(spark):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op4_against_the_public_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_byte_bpe(spark, SF).collect()}
    for d, text, _ in texts(spark):
        ids = library.encode_ordinary(text)
        assert got[d] == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op10_against_a_slow_version(spark):
    """Candidates by plain scanning of each text, and every tree walked by hand."""
    lexicon = secrets.read_lexicon(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    forest, config = secrets.fit_secrets(lexicon), secrets.SecretConfig()

    def candidates(text):
        out, taken = set(), 0
        for at, c in enumerate(text):
            if c in b"=:" and at >= taken and (m := secrets._VALUE.match(text, at)):
                a, b = m.span(m.lastindex)
                if m.lastindex == 4:  # without quotes, marks at the end are not part of it
                    taken = b
                    b = a + len(text[a:b].rstrip(b",;.)]}>"))
                if b - a >= config.short:
                    out.add((a, b))
        for m in re.finditer(rb"[0-9A-Za-z+\-/=_]+", text):
            a, b = m.span()
            if b - a < config.short or not re.search(rb"\d", m[0]):
                continue
            a += m[0].rstrip(b"=").rfind(b"=") + 1
            lead = text[max(0, a - 4) : a].rstrip(b" \"'")[-1:]
            if b - a >= config.long or (b - a >= config.short and lead in (b"=", b":") and lead):
                out.add((a, b))
        return sorted(out)

    def share(x):
        votes = []
        for feature, cut, child, value in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = child[node][int(x[feature[node]] > cut[node])]
            votes.append(value[node])
        return sum(votes) / len(votes)

    expected = []
    for d, text, path in texts(spark):
        raw = text.encode()
        say = lambda a, b, raw=raw: raw[a:b].decode("utf-8", "ignore")
        for a, b in candidates(raw):
            p = share(secrets.features(say(a, b), say(max(0, a - config.near), a), say(b, b + config.near), path or "", lexicon))
            expected.append((d, a, b, hashlib.sha256(raw[a:b]).hexdigest(), round(p, 9), p >= config.threshold))
    assert Counter((r[0], r[1], r[2], r[3], round(r[4], 9), r[5]) for r in queries.op10_secret_scans(spark, SF).collect()) == Counter(expected)
    assert expected


def test_op13_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = defaultdict(list)
    for r in queries.op13_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    asked = [int(i) for i in ids if i % 20 == 0]
    assert sorted(found) == sorted(asked) and all(len(v) == min(20, len(ids) - 1) for v in found.values())
    hits = 0
    for q in asked:
        s = x @ x[ids == q][0]
        best = sorted((-a, int(b)) for a, b in zip(s, ids) if b != q)[:20]
        hits += len({b for _, b in best} & {b for b, _ in found[q]})
        assert all(abs(score - s[ids == b][0]) < 1e-12 for b, score in found[q])
    assert hits >= 0.95 * 20 * len(asked)


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op7_lm_scoring", "op8_quality_classifier", "op9_language_id"])
def test_others_return_their_rows(spark, name):
    got = queries.QUERIES[name](spark, SF).collect()
    if name == "op3_benchmark_decontamination":
        assert got
    else:
        assert sorted(r.doc_id for r in got) == sorted(d for d, _, _ in texts(spark))

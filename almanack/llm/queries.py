"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm import bpe, chat, ctw, decontaminate, langid, multiindex, quality, resample, secrets, spelling, topk, warc
from almanack.llm.jaccard import jaccard_components
from almanack.llm.storage import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    read = warc.read_warc(manifest, payloads=False)
    return read.select(warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id(F.col("refers_to")).alias("refers_to"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(rows.withColumn("content", F.array(_part("text", "text"))), parts="content"))


def _part(kind: str | None, text: str | Column | None = None, width: int = 0) -> Column:
    """One typed part of a turn."""
    return F.struct(F.lit(kind).cast("string").alias("kind"), (F.col(text) if isinstance(text, str) else F.lit(text)).cast("string").alias("text"), F.lit("u").alias("uri"), F.lit(width).alias("width"), F.lit(28).alias("height"), F.lit(0.0).alias("seconds"), F.lit(0).alias("pages"))


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose texts come in two parts, cut anywhere, with an image and an unknown kind behind them."""
    text, half = F.coalesce("text", F.lit("")), (F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    parts = F.array(_part("text", F.left(text, half)), _part(None, F.substring(text, half + 1, F.length(text))), _part("Image", width=57), _part("video", F.lit("<|end|>")))
    made = chat.format_chats(table(spark, sf_dir, "conversations").withColumn("content", parts), parts="content")
    back = chat.digests(made)
    return back.join(made.select("conv_id", F.size("attachments").cast("long").alias("attachments"), "attachment_tokens"), "conv_id").select("conv_id", "n_turns", "turns_sha256", "attachments", "attachment_tokens")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = secrets.read_lexicon(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), secrets.fit_secrets(lexicon))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), config=spelling.SpellingConfig(noise=199))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multiindex.search(multiindex.build_index(vectors), vectors.filter("vec_id % 20 = 0"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' '))) AS g
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION
  SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.r)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to
FROM k
"""

OP5_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + 5 * (length(role) - length(replace(role, chr(10), '')))
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 8 + 1 + 8 AS chars FROM r
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS l, sum(chars) AS chars
  FROM e GROUP BY conv_id
)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256,
  chars::BIGINT AS formatted_chars FROM g
"""

PARTS_SQL = """
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, (2 * count(*))::BIGINT AS attachments, (3 * count(*))::BIGINT AS attachment_tokens,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || '<|image|><|file|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256
FROM conversations GROUP BY conv_id
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: CRC-32 of texts: ``_CRC_TABLE`` is a CTE with the table of bytes (``tab.t``), ``_crc32`` an expression over it.
_CRC_TABLE = "tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t)"


def _crc32(text: str) -> str:
    each = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({each}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _op11_words(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {table}"


OP11_SQL = f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, w, count(*) AS c FROM ({_op11_words('documents', 'doc_id')}) GROUP BY ALL),
b AS (SELECT w, count(*) AS c FROM ({_op11_words('benchmark', 'item_id')}) GROUP BY w),
v AS (SELECT w, {_crc32('w')} % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), tab),
s AS (SELECT bucket, sum(c) AS s FROM d JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM b JOIN v USING (w) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(c), 0) FROM d) AS s, (SELECT coalesce(sum(c), 0) FROM b) AS t),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.t, 0) + 1)::DOUBLE * (z.s + 10000)::DOUBLE) / ((s.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), z
),
w AS (SELECT doc_id, sum(c) AS n, sum(c * gain) AS weight FROM d JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
k AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN w USING (doc_id)
),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM k WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM k LEFT JOIN r USING (doc_id)
"""

OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, o AS (
  SELECT doc_id, translate(w, '{_UPPER}', '{_LOWER}') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY ALL
),
h AS (SELECT w, c, {_crc32("(doc_id || ':' || w)")} AS h FROM o, tab),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
e AS MATERIALIZED (
  SELECT word, n, word AS e FROM v
  UNION SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT))) FROM v
),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM e a JOIN e b ON a.e = b.e AND a.word <> b.word 
    AND (length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1)),
f AS MATERIALIZED (
  SELECT word, n, count(near) AS n_near, first(near ORDER BY m DESC, encode(near)) AS near, max(m) AS m
  FROM (SELECT word, n, near, m FROM v LEFT JOIN (SELECT word, near, m FROM near) USING (word)) GROUP BY word, n
),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN m >= 5 * n THEN near END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM f),
r AS (SELECT word, word AS root FROM g UNION ALL SELECT r.word, g.form FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL),
last AS (SELECT r.word, r.root FROM r JOIN g ON g.word = r.root WHERE g.form IS NULL)
SELECT g.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM g JOIN last USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_formatting": op5_chat_formatting,
    "chat_typed_parts": chat_typed_parts,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_secret_scans": op10_secret_scans,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
ORACLE: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_ngram_jaccard_join": OP2_SQL,
    "op5_chat_formatting": OP5_SQL,
    "chat_typed_parts": PARTS_SQL,
    "op6_exact_top_k": OP6_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}

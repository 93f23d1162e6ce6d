"""The corpus pipeline over ``documents``: quality, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; ``run`` writes it as Parquet to the shared folder and reads it back for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm import bpe, decontaminate, jaccard, quality, secrets, storage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained classifier rejects."""
    storage.small_batches(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, keep_columns=True)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of similar documents, once.

    Rows that repeat both id and text stay once, with the other columns of the row whose JSON is the least,
    whatever types they have; rows with a null id belong to no group and stay.
    """
    storage.small_batches(spark)
    groups = jaccard.jaccard_components(docs)
    keep = groups.filter("doc_id = component_id").select("doc_id")
    chosen, rest = docs.join(keep, "doc_id", "left_semi"), [c for c in docs.columns if c not in ("doc_id", "text")]
    if rest:
        other = F.struct(*(f"`{c}`" for c in rest))
        chosen = chosen.groupBy("doc_id", "text").agg(F.min_by(other, F.to_json(other)).alias("rest")).select("doc_id", "text", "rest.*")
    else:
        chosen = chosen.distinct()
    return chosen.unionByName(docs.filter("doc_id is null")).select(*(f"`{c}`" for c in docs.columns))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or within its share of word edits."""
    storage.small_batches(spark)
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in each text; every document stays. Without a column ``source`` all paths are empty."""
    storage.small_batches(spark)
    lexicon = secrets.read_lexicon(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return secrets.redact_secrets(docs, secrets.fit_secrets(lexicon))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text: all columns but the text, n_tokens, token_ids; columns of these names are replaced."""
    storage.small_batches(spark)
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ids.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("text")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", no_secrets),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the trained stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

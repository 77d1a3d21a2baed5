"""A corpus pipeline of five stages: quality rules, near-dedup, secret redaction, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. ``run`` writes every stage's
result to the shared folder and reads it back, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldshift.llm import byte_bpe, mixing, quality, secret_scan, simhash
from fieldshift.llm.support import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of rows with one id, one."""
    return simhash.keep_first(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind."""
    model = secret_scan.default_model(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return secret_scan.redact(docs, model).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of source, language and topic."""
    return mixing.sample(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("secret scans", secret_redaction),
    ("source mixing", source_mixing),
    ("byte-level bpe", bpe_encoding),
]

#: Fingerprints, forests and BPE have no SQL: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

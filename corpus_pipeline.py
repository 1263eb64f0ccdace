"""The corpus pipeline: quality, exact dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one
the packed pieces; run() writes every stage to the shared folder, rereads it, and deletes what only earlier stages needed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.llm import digest_index, near_dup, packing, quality, secrets
from seriata.llm.common import Tables, materialize, table

NEAR = 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects go: score below the classifier's threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_score").where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = digest_index.DigestIndex(spark, digest_index.fresh_name())
    kept = digest_index.drop_exact_copies(docs, index)
    index.drop()  # what goes is decided and written
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_copies(docs, NEAR)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    return secrets.redact(docs, secrets.train_for(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secret_scan), ("packing", pack)]

#: A learned classifier and a tokenizer are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Tables(spark) as own:
            kept = stage(spark, docs, sf_dir)
        docs = materialize(kept, f"pipeline-{name}", instead_of=docs)
        own.release()
    return STAGES[-1][1](spark, docs, sf_dir)

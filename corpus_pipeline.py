"""Cleaning a corpus in stages; each takes (spark, docs, sf_dir) and returns the documents that go on.

Documents are told apart by doc_id, those without one by their texts. Extra columns are dropped. A later stage sees only what its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfinder.llm import bpe_chunks, decontaminate, jaccard_tiles, secret_forest, toxicity
from spanfinder.llm.tables import keep, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NAMED = 1 << 62  # documents without an id are named by their text's hash, beyond other ids
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject."""
    return toxicity.clean(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id; five-word shingles, similarity of 0.8 or more."""
    # one key for both the choice and the removal of repeated rows, so that texts move once
    at = F.coalesce(F.col("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(NAMED)).alias("_at")
    docs = docs.select(*COLUMNS, at)
    kept = jaccard_tiles.join(docs, "_at", words=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN).select(F.col("component_id").alias("_at")).distinct()
    return docs.join(kept, "_at", "left_semi").dropDuplicates(["_at", "text"]).drop("_at")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    leaks = decontaminate.find(docs, read(spark, sf_dir, "benchmark"), "_key").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(leaks, "_key", "left_anti").drop("_key")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and the lengths of these texts counted anew."""
    docs = docs.select(COLUMNS)
    masked = secret_forest.redact(docs, secret_forest.scan(docs))
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit(secret_forest.MASK)), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    import public_tokenizers

    out = bpe_chunks.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("benchmark", drop_leaks), ("secrets", mask_secrets), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Corpus pipeline: language, near-duplicates, benchmark passages, source mix, token records.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's documents. All but the last return the columns of ``documents``.
Each stage works on every row that its predecessor kept; empty tables give empty results.
The executors serve all stages, and keep from one what it once took; every stage bounds the session's Arrow batches by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfage.llm import decontaminate, langid, minhash, mixing, records
from shelfage.session import bounded_batches, scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with hardly any n-gram of a learned language, go."""
    bounded_batches(spark)
    return langid.filtered(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the smallest doc_id."""
    bounded_batches(spark)
    return minhash.deduplicated(spark, docs, shingle=5, similarity=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words go."""
    bounded_batches(spark)
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of their source reads them."""
    bounded_batches(spark)
    return mixing.mixed_documents(spark, docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records written and read back: one row per record."""
    bounded_batches(spark)
    return records.roundtrip(spark, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_records", token_records),
]

#: MinHash candidates, seeded mixing and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

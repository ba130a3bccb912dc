"""Corpus pipeline: quality rules, near-dedup, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`; the last returns the packed pieces. Each stage works
on all rows that its predecessor kept. Defined cases (nulls, empty and long texts, ties, repeated rows, empty
tables, further columns) are those of the operators; further columns pass through to the last stage.

ORACLE_SQL is None: fingerprints, spans and packing have no SQL form, so the run is tested against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import packing, quality, secrets, simhash, suffixes
from palimpsest.llm.common import documents, ensure_checkpoint_dir

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, less the lines that too many documents of their source share."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more): the least doc_id, then text. Candidates by SimHash and its byte-position index, completed by minima, each decided exactly."""
    return simhash.drop_near_copies(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, less the passages of 200 bytes or more that start anywhere else too."""
    return suffixes.remove_repeats(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by markers."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequence and offset."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_dedup", repeats_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    docs, folder = documents(spark, sf_dir), f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

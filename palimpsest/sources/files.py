"""File scans: batch and streaming reads of raw bytes, with the admission rule as a column. Spark lists no files below hidden folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import config

RAW_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def admitted(path: Column, length: Column) -> Column:
    """True for files to read: not empty, not too large, no skipped hidden part and no skipped suffix."""
    parts = F.split(path, "/")
    skipped = F.array(*map(F.lit, config.SKIPPED_PARTS))
    hidden = F.filter(parts, lambda p: F.startswith(p, F.lit(".")))
    suffix = F.regexp_extract(F.element_at(parts, -1), r"[^.](\.[^.]+)$", 1)
    return (length > 0) & (length <= config.MAX_FILE_BYTES) & ~F.arrays_overlap(hidden, skipped) & ~F.array_contains(skipped, suffix)


def raw_documents(files: DataFrame) -> DataFrame:
    """Admitted files as raw documents, one per content in the batch, or in a stream within an hour of watermark."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.filter(admitted(F.col("path"), F.col("length"))).select(
        F.lit("filesystem").alias("source_type"), F.col("path").alias("source_path"), F.col("content").alias("raw_bytes"), F.col("modificationTime").alias("captured_at"), F.sha2("content", 256).alias("checksum"),
        F.create_map(F.lit("filename"), name, F.lit("extension"), F.regexp_extract(name, r"(\.[^.]+)$", 1), F.lit("size"), F.col("length").cast("string")).alias("source_metadata"), F.lit(2).alias("priority"),
    )
    if rows.isStreaming:
        return rows.withWatermark("captured_at", "1 hour").dropDuplicatesWithinWatermark(["checksum"])
    return rows.dropDuplicates(["checksum"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return raw_documents(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def stream_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive; deduplicate with a watermark downstream."""
    return spark.readStream.format("binaryFile").schema(RAW_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(path)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines appended to log files under path."""
    return spark.readStream.text(path)

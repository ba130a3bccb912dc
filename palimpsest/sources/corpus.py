"""The document memory's corpus, derived from a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS = 512  #: rows of a batch that Spark sends to a Python worker: with its default of 10,000 these grow with a task's rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; the session's Arrow batches get no larger than ARROW_ROWS."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_BYTES = 1 << 30  #: a scan of up to so many bytes may be dealt anew


def spread(df: DataFrame) -> DataFrame:
    """A scan of few bytes in few row groups, which would keep most cores idle, dealt over the cores. Larger scans are never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def captured(docs: DataFrame) -> DataFrame:
    """document_id, text, lang, source, source_type, source_path, captured_at, checksum, body (paragraphs apart)."""
    kind = F.element_at(F.array(*map(F.lit, ("filesystem", "browser", "terminal", "clipboard"))), (F.col("doc_id") % 4 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".py", ".html", ".eml", ".pdf"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("document_id"), "text", "lang", "source", kind.alias("source_type"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), ending).alias("source_path"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("captured_at"),
        F.sha2("text", 256).alias("checksum"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(spread(table(spark, sf_dir, "documents")))


AS_OF = "2025-01-01 00:00:00"

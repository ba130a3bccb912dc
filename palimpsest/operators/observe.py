"""Statistics, percentiles and service levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions.text import nearest_rank


def latest(observations: DataFrame, keep: int = 1000) -> DataFrame:
    """The last `keep` observations (metric, value, ts, seq) of each metric."""
    w = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("seq"))
    return observations.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def percentiles(observations: DataFrame, keep: int = 1000) -> DataFrame:
    """metric, n, p50, p95, p99 by nearest rank over the last observations (at most `keep` a group)."""
    values = F.collect_list("value")
    rows = latest(observations, keep).groupBy("metric").agg(F.count("*").alias("n"), values.alias("v"))
    return rows.select("metric", "n", *(F.round(nearest_rank(F.col("v"), p), 6).alias(f"p{p}") for p in (50, 95, 99)))


def gauges(observations: DataFrame) -> DataFrame:
    """Per metric the sum as counter and the last value as gauge."""
    return observations.groupBy("metric").agg(F.round(F.sum("value"), 4).alias("counter"), F.round(F.max_by("value", F.struct("ts", "seq")), 6).alias("gauge"))


def slo_report(spark: SparkSession, observations: DataFrame) -> DataFrame:
    """Each service level with its p95; it passes when p95 is within the alert threshold or there is no data."""
    levels = spark.createDataFrame([*config.SLOS], "slo string, metric string, target double, alert_threshold double")
    out = levels.join(percentiles(observations), "metric", "left")
    return out.select("slo", "metric", "target", "alert_threshold", F.round("p95", 2).alias("p95"), F.coalesce(F.col("p95") <= F.col("alert_threshold"), F.lit(True)).alias("passed"))


def throughput_violated(p50_ms, least_per_minute: float = 10.0):
    return (p50_ms > 0) & (60000.0 / p50_ms < least_per_minute)


def count_by_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_type").agg(F.count("*").alias("n_documents"))


def stats_overview(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, entities: DataFrame, turns: DataFrame, mention_rows: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """One row of totals, of documents by source, and of the shares of chunks with a vector and of documents with an entity, in percent with one decimal, 0 when empty. docs: with status."""
    share = lambda n, of: F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col(n), F.col(of)), 1), F.lit(0.0))
    held = chunks.join(vectors.select(F.col("id").alias("chunk_id"), F.lit(1).alias("_v")), "chunk_id", "left")
    by_source = docs.groupBy("source_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("by_source"))  # a row per source
    totals = [
        docs.agg(F.count("*").alias("documents"), F.count_if(F.col("status").isin("FAILED", "PARSE_FAILED", "FORGET_FAILED")).alias("failed")), by_source,
        held.agg(F.count("*").alias("chunks"), F.count("_v").alias("embedded_chunks")), entities.agg(F.count("*").alias("entities")), turns.agg(F.countDistinct("session_id").alias("conversations")),
    ]
    totals += [] if mention_rows is None else [mention_rows.join(docs.select("document_id"), "document_id", "left_semi").agg(F.countDistinct("document_id").alias("linked_documents"))]
    totals += [] if relations is None else [relations.agg(F.count("*").alias("relations"))]
    out = totals[0]
    for one in totals[1:]:
        out = out.join(F.broadcast(one))  # one row each
    out = out.withColumn("embedding_coverage_pct", share("embedded_chunks", "chunks"))
    return out if mention_rows is None else out.withColumn("graph_coverage_pct", share("linked_documents", "documents"))


def health(checks: DataFrame) -> DataFrame:
    """(store, ok) rows to one row: healthy and the failing stores."""
    return checks.agg(F.bool_and("ok").alias("healthy"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("store")))).alias("failing"))

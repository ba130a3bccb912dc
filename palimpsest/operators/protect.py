"""Insert-if-absent, status changes, forgetting and retention, as DataFrame to DataFrame rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import Settings


def first_of_checksum(rows: DataFrame, order: str = "document_id", store: DataFrame | None = None) -> DataFrame:
    """Rows whose checksum is new: the first of each in the batch, none that the store has."""
    w = Window.partitionBy("checksum").orderBy(order)
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return once.join(store.select("checksum"), "checksum", "left_anti") if store is not None else once


def arrival_decision(status: Column, retries: Column, max_retries: int = 5) -> Column:
    """What to do with a document that arrives again; null status: new."""
    return F.when(status.isNull(), "NEW").when(status.isin("INDEXED", "EMBEDDED"), "SKIP").when(status.isin("FAILED", "PARSE_FAILED"), F.when(retries >= max_retries, "SKIP").otherwise("RERUN_CLEAN")).otherwise("RERUN")


def failed(docs: DataFrame, ids: DataFrame, max_retries: int = 5) -> DataFrame:
    """docs with one more retry for the ids, and FAILED or ABANDONED."""
    hit = docs.join(ids.select("document_id").distinct().withColumn("_hit", F.lit(True)), "document_id", "left")
    more = F.col("retry_count") + F.when(F.col("_hit"), 1).otherwise(0)
    status = F.when(F.col("_hit"), F.when(more >= max_retries, "ABANDONED").otherwise("FAILED")).otherwise(F.col("status"))
    return hit.withColumn("status", status).withColumn("retry_count", more).drop("_hit")


def with_status(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with the last status of each document in changes (document_id, status, changed_at); others keep theirs."""
    last = changes.groupBy("document_id").agg(F.max_by("status", F.struct("changed_at", "status")).alias("_new"))
    return docs.join(last, "document_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def purge_raw(docs: DataFrame, as_of: str, settings: Settings = Settings(), by_date: bool = False) -> DataFrame:
    """docs with raw content older than the retention days set to null and stamped; by_date: whole days only."""
    now = F.lit(as_of).cast("timestamp_ntz")
    limit = now - F.make_dt_interval(F.lit(settings.purge_after_days))
    old = F.col("captured_at").cast("date") < limit.cast("date") if by_date else F.col("captured_at") < limit
    due = F.col("raw_content").isNotNull() & old
    return docs.withColumn("raw_purged_at", F.when(due, now)).withColumn("raw_content", F.when(due, None).otherwise(F.col("raw_content")))


def forget(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table that has a document_id column, less the rows of the ids; entities without a mention left go too."""
    keys = ids.select("document_id").distinct()
    out = {name: df.join(keys, "document_id", "left_anti") if "document_id" in df.columns else df for name, df in tables.items()}
    if {"entities", "mentions"} <= set(out):
        out["entities"] = without_orphans(out["entities"], out["mentions"])
    return out


def without_orphans(entities: DataFrame, mention_rows: DataFrame) -> DataFrame:
    return entities.join(mention_rows.select(F.col("name").alias("canonical_name")).distinct(), "canonical_name", "left_semi")


def orphans(entities: DataFrame, mention_rows: DataFrame) -> DataFrame:
    return entities.join(mention_rows.select(F.col("name").alias("canonical_name")).distinct(), "canonical_name", "left_anti")


def verify_forgotten(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """One row per table: rows of the ids left in it, and whether none are."""
    keys = ids.select("document_id").distinct()
    parts = [df.join(keys, "document_id", "left_semi").agg(F.count("*").alias("remaining")).select(F.lit(name).alias("table_name"), "remaining") for name, df in sorted(tables.items()) if "document_id" in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("verified", F.col("remaining") == 0)


def expired_turns(turns: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """Turns past retention."""
    return turns.filter(F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(settings.retain_turns_days)))

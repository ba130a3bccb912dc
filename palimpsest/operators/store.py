"""Tables of the memory: plain Parquet folders that Spark appends to, and rewrites by part.

Rows are partitioned by `part`, a hash of their key, so an append touches no other file and a deletion rewrites only the
parts that hold the keys. Parts that are written again are first written beside the table, and then put in place by Spark's
dynamic overwrite: a run that is lost in between is finished when the folder is opened next. Paths go through Hadoop's file
system API, so any store that Spark reaches will do; one writer at a time is assumed, as Parquet folders have no locks.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 32


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session on this machine alone may get one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared checkpoint folder, for several readers."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class TableFolder:
    """Named tables under a path, each partitioned by the hash of its key column."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], parts: int = PARTS) -> None:
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in [f.getPath().getName() for f in self._fs.listStatus(self._at("_beside"))] if self._fs.exists(self._at("_beside")) else []:
            self._finish(name)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}".rstrip("/"))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{name}/_SUCCESS"))

    def scan(self, name: str) -> DataFrame:
        """The rows with their part. The schema is kept beside, as a table without rows has no file to tell it."""
        schema = self.spark.read.parquet(f"{self.path}/_schemas/{name}").schema
        return self.spark.read.schema(schema.add("part", "integer")).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.scan(name).drop("part")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in self.keys if self.has(name)}

    def _dealt(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", part_of(F.col(self.keys.get(name, "document_id")), self.parts))

    def append(self, name: str, rows: DataFrame) -> None:
        if not self.has(name):
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/_schemas/{name}")
        self._dealt(name, rows).write.mode("append").partitionBy("part").parquet(f"{self.path}/{name}")

    def delete(self, name: str, column: str, keys: DataFrame) -> None:
        """Remove the rows whose `column` is among the keys; only the parts that hold such rows are written again."""
        if not self.has(name):
            return
        rows = self.scan(name)
        wanted = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
        parts = [r["part"] for r in rows.join(wanted, column, "left_semi").select("part").distinct().collect()]  # at most the table's parts
        if parts:
            self._swap(name, parts, rows.filter(F.col("part").isin(parts)).join(wanted, column, "left_anti").drop("part"))

    def replace(self, name: str, rows: DataFrame) -> None:
        """The whole table anew."""
        if self.has(name):
            self._swap(name, list(range(self.parts)), rows)
        else:
            self.append(name, rows)

    def upsert(self, name: str, column: str, rows: DataFrame) -> None:
        """Rows take the place of those with the same key."""
        rows = settled(rows)
        self.delete(name, column, rows.select(column))
        self.append(name, rows)

    def drop(self, name: str) -> None:
        """The table with its schema."""
        for folder in (name, f"_schemas/{name}"):
            self._fs.delete(self._at(folder), True)

    def _swap(self, name: str, parts: list[int], rows: DataFrame) -> None:
        self.spark.createDataFrame([(p,) for p in parts], "part int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_beside/{name}/parts")
        self._dealt(name, rows).write.mode("overwrite").parquet(f"{self.path}/_beside/{name}/rows")
        self._finish(name)

    def _finish(self, name: str) -> None:
        """Put the parts that were written beside the table in place; nothing happens if they are not whole. May be repeated."""
        beside = f"_beside/{name}"
        if self.has(f"{beside}/parts") and self.has(f"{beside}/rows"):
            after = self.spark.read.parquet(f"{self.path}/{beside}/rows")
            after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
            there = {r["part"] for r in after.select("part").distinct().collect()}
            for gone in {r["part"] for r in self.spark.read.parquet(f"{self.path}/{beside}/parts").collect()} - there:  # at most the table's parts
                self._fs.delete(self._at(f"{name}/part={gone}"), True)
        self._fs.delete(self._at(beside), True)

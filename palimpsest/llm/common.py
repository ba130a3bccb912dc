"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
U64 = np.uint64
#: Odd multipliers of the 64-bit finaliser (public splitmix64 constants) - fixed values.
MIX_1, MIX_2, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_BYTES = 1 << 30  #: a table of up to so many bytes may be dealt anew


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; where they are few bytes in fewer row groups than there are cores, dealt over the cores. Larger tables are never shuffled for this."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    small = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return docs.repartition(cores) if small and docs.rdd.getNumPartitions() < cores else docs


def slices(batches: Batches, rows: int = 1000, most: int = 16 << 20) -> Batches:
    """The batches in slices of at most `rows` rows and about `most` bytes, so that what a task holds besides a batch is bounded."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * most // max(b.nbytes, 1))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. Only a session on this machine alone may get one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable copy of df in the shared checkpoint folder; lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 arrays; new array."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts with null as empty."""
    return [x or "" for x in column.to_pylist()]


def rows_to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def carried(docs: DataFrame) -> DataFrame:
    """One column `row` that holds all columns of docs, so that helper columns beside it clash with none of them."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def texts_in(b: pa.RecordBatch) -> pa.Array:
    """The texts of the rows that `carried` packed."""
    rows = b.column("row")
    return rows.flatten()[rows.type.get_field_index("text")]


def retexted(b: pa.RecordBatch, texts: list) -> pa.RecordBatch:
    """The rows that `carried` packed, with other texts and n_chars (where it is a column) made to fit."""
    rows = b.column("row")
    new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
    columns = [pa.array(new[f.name], type=f.type) if f.name in new else x for f, x in zip(rows.type, rows.flatten(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in rows.type])


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n+1 offsets of its rows (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and n else np.empty(0, np.uint8)
    return raw, at - (at[0] if n else 0)


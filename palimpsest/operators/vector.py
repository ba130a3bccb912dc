"""Vector search over stored embeddings, embedding of texts, and model migration."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.arrow import slices


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


BLOCK_ROWS, QUERY_ROWS, SKETCH_BITS = 16_384, 2_048, 512
_CELL = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("similarity", pa.float64())])


def _unit(lists: list, dims: int) -> np.ndarray:
    """Vectors at length 1; null ones and those of another length are 0."""
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        if v is not None and len(v) == dims and None not in v:
            out[i] = v
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _best(ids: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Places of the k most similar, ties to the smaller id."""
    if len(ids) > k:
        near = np.flatnonzero(similarity >= np.partition(similarity, -k)[-k])
        return near[np.lexsort((ids[near], -similarity[near]))[:k]]
    return np.lexsort((ids, -similarity))


def _cell(k: int, planes: np.ndarray | None, share: float):
    """Task over a block of vectors and a block of queries: k rows a query. planes: only the share of rows with the nearest sketch is scored."""

    def sketch(x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ planes.T > 0, axis=1).view(np.uint64)

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _CELL.empty_table()
        asked = queries.column("vector").to_pylist()
        dims = max(len(v) for v in asked)
        x, q = _unit(vectors.column("vector").to_pylist(), dims), _unit(asked, dims)
        ids = vectors.column("id").to_numpy()
        few = max(k, int(np.ceil(share * len(ids))))
        own = sketch(x) if planes is not None and few < len(ids) else None
        wanted = None if own is None else sketch(q)
        out: list[list[np.ndarray]] = [[], [], []]
        for i, name in enumerate(queries.column("query_id").to_pylist()):
            rows = slice(None) if own is None else np.argpartition(np.bitwise_count(own ^ wanted[i]).sum(axis=1), few - 1)[:few]
            similarity = np.maximum(np.round(x[rows] @ q[i], 9), 0.0)
            best = _best(ids[rows], similarity, k)
            for o, c in zip(out, (np.full(len(best), name), ids[rows][best], similarity[best]), strict=True):
                o.append(c)
        return pa.Table.from_arrays([pa.array(np.concatenate(o), type=f.type) for o, f in zip(out, _CELL, strict=True)], schema=_CELL)

    return run


def _in_blocks(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None, planes: np.ndarray | None, share: float) -> DataFrame:
    """The query set against all vectors in the cells of a grid: vectors are dealt to blocks by id, queries by query_id."""
    rows = (vectors.filter(where) if where is not None else vectors).select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = queries.filter("query_vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("vector"))
    blocks, parts = (max(1, -(-df.count() // most)) for df, most in ((rows, BLOCK_ROWS), (asked, QUERY_ROWS)))
    left = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    right = asked.withColumns({"part": F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))})
    scored = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_cell(k, planes, share), "query_id long, id string, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, where: Column | None = None) -> DataFrame:
    """query_id, id, similarity (at least 0), place. vectors: id, embedding; queries: query_id, query_vector.

    Exact: each block of queries is multiplied with each block of vectors, and a cell returns k rows a query.
    """
    return _in_blocks(vectors, queries, k, where, None, 1.0)


def lsh_nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, bits: int = SKETCH_BITS, share: float = 0.15, seed: int = 7) -> DataFrame:
    """As nearest, but only the `share` of each block whose sketches (signs of random projections) differ least from the query's is scored.

    Every vector has a sketch. The default share is chosen for a recall of at least 0.9 on vectors without clusters (the tests measure it);
    clustered ones need less. A share of 1 is exact.
    """
    dims = queries.select(F.max(F.size("query_vector"))).first()[0] or 1
    return _in_blocks(vectors, queries, k, None, np.random.default_rng(seed).standard_normal((bits, dims)), share)


def hashing_embedder(dims: int = 64) -> Callable[[pd.Series], pd.Series]:
    """Offline default: signed word hashing to a unit vector."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def embedded(chunks: DataFrame, model: str, version: str, embed: Callable[[pd.Series], pd.Series] | None = None, tries: int = 3) -> DataFrame:
    """Vector records of chunks, embedded in batches of up to 256 texts; one that fails `tries` times gives null vectors."""
    function = embed or hashing_embedder()

    def tried(texts: pd.Series) -> pd.Series:
        for _ in range(tries):
            try:
                return function(texts)
            except Exception:  # noqa: BLE001 - a model's failure is a null vector, by contract
                continue
        return pd.Series([None] * len(texts))

    kind = pa.list_(pa.float32())

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        done = [pa.array(list(tried(s.column(0).to_pandas())), kind) for s in slices([pa.RecordBatch.from_arrays([texts], ["text"])])]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return chunks.withColumn("embedding", run("content")).withColumns({"embed_model": F.lit(model), "embed_model_version": F.lit(version)})


def linked(chunks: DataFrame, vectors: DataFrame, as_of: str) -> DataFrame:
    """chunks with vector_id and embedded_at; null where there is no vector."""
    have = vectors.filter("embedding is not null").select(F.col("id").alias("chunk_id"), F.col("id").alias("vector_id"), F.lit(as_of).cast("timestamp_ntz").alias("embedded_at"))
    return chunks.join(have, "chunk_id", "left")


def migration_progress(chunks: DataFrame, vectors: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """One row: total_chunks, migrated_chunks, progress_pct (0 when empty), status."""
    done = chunks.join(vectors.select(F.col("id").alias("_id")).distinct(), F.col(id_column) == F.col("_id"), "left")
    out = done.agg(F.count("*").alias("total_chunks"), F.count("_id").alias("migrated_chunks"))
    pct = F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("migrated_chunks"), F.col("total_chunks")), 1), F.lit(0.0))
    return out.withColumn("progress_pct", pct).withColumn("status", F.when(F.col("migrated_chunks") == F.col("total_chunks"), "COMPLETE").otherwise("IN_PROGRESS"))


def registry(log: DataFrame) -> DataFrame:
    """model_id, name, version, path, registered_at, status, is_active from the log of what happened to models (at, model_id, name, version, path, status, noted_at).

    The log only grows, so one appended row switches the active model: it is the one that became ACTIVE last.
    """
    rows = log.groupBy("model_id", "name", "version").agg(F.max_by("path", "at").alias("path"), F.min("noted_at").alias("registered_at"), F.max_by("status", "at").alias("status"))
    active = log.filter("status = 'ACTIVE'").agg(F.max_by("model_id", "at").alias("active"))  # one row
    return rows.join(F.broadcast(active)).withColumn("is_active", F.coalesce(F.col("model_id") == F.col("active"), F.lit(False))).drop("active")


def validated(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, vectors, missing, empty (null vectors), valid (none missing, none empty)."""
    both = chunks.select("chunk_id").join(vectors.select(F.col("id").alias("chunk_id"), F.col("embedding").isNull().alias("is_null")), "chunk_id", "left")
    out = both.agg(F.count("*").alias("chunks"), F.count("is_null").alias("vectors"), F.count_if(F.col("is_null").isNull()).alias("missing"), F.count_if("is_null").alias("empty"))
    return out.withColumn("valid", (F.col("missing") == 0) & (F.col("empty") == 0))

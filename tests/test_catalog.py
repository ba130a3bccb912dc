"""Each registered query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from palimpsest.plans import catalog
from tests.conftest import SMALL

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")
_SQL, _QUERIES = catalog.oracle_sql(), catalog.queries()


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    cell = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(_SQL))
def test_same_rows(spark, duck, name):
    got, want = _QUERIES[name](spark, SMALL).toPandas(), duck.execute(_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(_QUERIES) - set(_SQL)))
def test_runs(spark, name):
    assert _QUERIES[name](spark, SMALL).count() > 0


def test_vectors_of_all_chunks(spark):
    """embed_chunks over its whole table against a plain version."""
    chunks = {r.chunk_id: r.content for r in catalog._chunks(spark, SMALL).collect()}
    got = _QUERIES["embed_chunks"](spark, SMALL).collect()
    assert {r.chunk_id for r in got} == set(chunks) and len(got) == len(chunks)
    for r in got:
        v = np.zeros(64)
        for word in chunks[r.chunk_id].lower().split():
            h = zlib.crc32(word.encode())
            v[h % 64] += 1 if h >= 1 << 31 else -1
        assert np.allclose(r.embedding, v / (np.linalg.norm(v) or 1), atol=1e-6)

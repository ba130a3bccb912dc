"""Python work on Arrow batches in slices: a batch holds up to 10,000 rows, whose Python objects would all be there at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ROWS, BYTES = 256, 1 << 20  #: most rows and (but for one longer row) bytes of a slice


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > most:
                n //= 2
            yield b.slice(at, n)
            at += n


def of_texts(function: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A column function that maps each text but null ones."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        done = [pa.array([None if t is None else function(t) for t in s.column(0).to_pylist()], pa.string()) for s in slices([pa.RecordBatch.from_arrays([texts], ["text"])])]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return run

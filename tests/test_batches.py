"""What a Python worker is sent at once does not grow with a task's rows."""

from __future__ import annotations

from palimpsest.sources.corpus import ARROW_ROWS, corpus


def test_batches_are_small(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = corpus(spark, "/root/testdata/sf0.01").coalesce(1).select("document_id")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= ARROW_ROWS

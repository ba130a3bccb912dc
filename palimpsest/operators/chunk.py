"""Overlapping chunks of documents: paragraphs (or code blocks) merged up to a budget."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions.arrow import slices

_PARAGRAPH = re.compile(r"\n\s*\n")
_BLOCK = re.compile(r"\n(?=(?:def |class |function |async |pub |fn |impl ))")


def budget(kind: Column) -> Column:
    """Budget name of a content type."""
    return F.when(kind.isin("code", "email", "pdf", "image"), kind).otherwise(F.lit("prose"))


def blocks_of(text: str, kind: str) -> list[str]:
    parts = _BLOCK.split(text) if kind == "code" else []
    return parts if len(parts) > 1 else _PARAGRAPH.split(text)


def merge(blocks: list[str], target: int, overlap: int) -> list[tuple[str, int]]:
    """(text, start) of the chunks. A block never splits; a chunk begins with the end of the one before it."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    size = start = at = 0
    for block in map(str.strip, blocks):
        if not block:
            at += 1
            continue
        if size and size + len(block) + 2 > target:
            text = "\n\n".join(parts)
            out.append((text, start))
            parts = [text[-overlap:], block] if 0 < overlap < size else [block]
            start = at
        else:
            if not size:
                start = at
            parts.append(block)
        size = sum(map(len, parts)) + 2 * (len(parts) - 1) if len(parts) < 3 else size + len(block) + 2
        at += len(block) + 2
    if parts:
        out.append(("\n\n".join(parts), start))
    return out


_OUT = [("chunk_index", pa.int64()), ("total_chunks", pa.int64()), ("content", pa.string()), ("token_count", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())]


def chunks(docs: DataFrame, text: str = "body", kind: str | None = None, key: str = "document_id") -> DataFrame:
    """key, chunk_id, chunk_index, total_chunks, content, token_count, start_char, end_char. kind: a column of content types; none: prose.

    One pass in Arrow batches, linear in a text's length; nothing is shuffled. Null or blank texts give no rows.
    """
    kinds = budget(F.col(kind)) if kind else F.lit("prose")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), kinds.alias("kind"))
    schema = pa.schema([("key", pa.from_numpy_dtype("int64") if dict(rows.dtypes)["key"] == "bigint" else pa.string()), *_OUT])

    def run(batches):
        for b in slices(batches):
            out = []
            for k, t, name in zip(*(b.column(c).to_pylist() for c in ("key", "text", "kind")), strict=True):
                target, overlap = (config.CHARS_PER_TOKEN * x for x in config.CHUNK_BUDGETS[name])
                found = merge(blocks_of(t, name), target, overlap) if t and t.strip() else []
                out += [(k, i, len(found), x.strip(), max(1, len(x) // config.CHARS_PER_TOKEN), s, s + len(x)) for i, (x, s) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, schema, strict=True)], schema=schema)

    ddl = f"key {dict(rows.dtypes)['key']}, chunk_index long, total_chunks long, content string, token_count long, start_char long, end_char long"
    return rows.mapInArrow(run, ddl).select(F.col("key").alias(key), F.concat_ws(":", "key", "chunk_index").alias("chunk_id"), "chunk_index", "total_chunks", "content", "token_count", "start_char", "end_char")

"""Quality rules with cross-document line frequency.

Each line is normalised (lower case, digits as 0, inner white space as one space) and hashed; per host (the
`source` column) the distinct documents of each line are counted. Lines in more documents than the limit are
boilerplate: `keep_good` removes them from the texts, and a document that is left with fewer than `min_words`
words is rejected as depleted, besides those that fail the fixed base rules.

Copies would make every line of a clean text look like boilerplate. So a line's documents are told apart by
the whole set of their line hashes: copies with the same normalised lines count as one document, all others by themselves.
A host's documents, of which the limit is a share, are counted alike.

Defined cases. Null or empty text: no words, base_failed. Null source: a host of its own. Repeated rows: each
row is judged by itself; with equal texts in one host they count once for their lines. Verdict and removed lines depend
on text and host only, so rows of one doc_id are judged apart. Empty table: no rows. Other columns are ignored by
`line_report` and kept by `keep_good`, which makes n_chars fit the text left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import GOLDEN, U64, Batches, carried, checkpointed, mix, retexted, rows_to_batch, slices, texts_in, texts_of

WINDOW = 8  #: words of a window that may not repeat
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
_DIGITS = bytes(48 if 48 <= c < 58 else c for c in range(256))


@dataclass(frozen=True)
class QualityRules:
    """min_words and max_repeat_percent are the base rules. A line is boilerplate in a host in more distinct documents than
    line_share of the host's documents, this limit being no less than line_docs and no more than line_docs_most."""

    min_words: int = 20
    max_repeat_percent: int = 30
    line_docs: int = 20
    line_share: float = 0.01
    line_docs_most: int = 1000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of `window` words that occur twice or more in the list."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    codes = mix(np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64) * GOLDEN + GOLDEN)
    if len(ids) > n - window:  # a repeated window repeats `window` words or overlaps itself
        return 0
    acc = np.zeros(n - window + 1, dtype=np.uint64)
    for k in range(window):
        acc = acc * U64(0xD1342543DE82EF95) + codes[k : k + len(acc)]
    order = np.argsort(acc, kind="stable")
    same = acc[order[1:]] == acc[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(acc) + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def normalised_lines(text: str) -> list[bytes]:
    """The lines of a text in lower case, digits as 0, inner white space as one space; lines without a word are empty."""
    return [b" ".join(x.split()) for x in text.lower().encode("utf-8", "surrogatepass").translate(_DIGITS).split(b"\n")]


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    h = xxhash.xxh64_intdigest(line)
    return h - (1 << 64) if h >= 1 << 63 else h


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words of each line."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    duplicates, counts = 0, {}
    for line, plain in zip(raw.split(b"\n"), normalised_lines(text), strict=True):
        if not plain:
            continue
        duplicates += line in seen
        seen.add(line)
        h = line_hash(plain)
        counts[h] = counts.get(h, 0) + plain.count(b" ") + 1
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicates, repeated_words(words), list(counts), list(counts.values())


def without_lines(text: str, lost: set[int]) -> str:
    """The text less the lines whose hash is in lost."""
    return "\n".join(line for line, plain in zip(text.split("\n"), normalised_lines(text), strict=True) if not plain or line_hash(plain) not in lost)


_STATS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
_KEY = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("text_key", _KEY), ("host", pa.string()), *_STATS, ("line", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])
_OUT_DDL = "doc_id long, text_key struct<a: long, b: long>, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<long>"


def _measured(batches: Batches) -> Batches:
    for b in slices(batches):
        found = [measure(t) for t in texts_of(b.column("text"))]
        yield rows_to_batch(_OUT, [b.column("doc_id"), b.column("text_key"), b.column("host"), *([x[i] for x in found] for i in range(7))])


def _text_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _host(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def _stats(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    stats = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("text_key"), _host(docs["source"]).alias("host")).mapInArrow(_measured, _OUT_DDL)
    return checkpointed(stats.withColumn("row_key", F.monotonically_increasing_id()))


def _lost_lines(stats: DataFrame, rules: QualityRules) -> DataFrame:
    """(row_key, line, line_words) for each boilerplate line of each row."""
    identity = F.xxhash64(F.array_sort("line"))  # a document's line hashes are distinct
    hosts = stats.select("host", identity.alias("document")).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = stats.select("row_key", "host", identity.alias("document"), F.explode(F.arrays_zip("line", "line_words")).alias("x")).select("row_key", "host", "document", F.col("x.line").alias("line"), F.col("x.line_words").alias("line_words"))
    # Distinct (host, line, document) combine before the shuffle, so a very common line reaches it once per task and document.
    frequency = lines.select("host", "line", "document").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    limit = F.least(F.lit(float(rules.line_docs_most)), F.greatest(F.lit(float(rules.line_docs)), F.col("host_docs") * rules.line_share))
    common = frequency.filter(F.col("n_docs") > min(rules.line_docs, rules.line_docs_most)).join(hosts, "host").filter(F.col("n_docs") > limit).select("host", "line")
    return lines.join(common, ["host", "line"]).select("row_key", "line", "line_words")


def _judged(stats: DataFrame, lost: DataFrame, rules: QualityRules) -> DataFrame:
    """stats with lost_words, lost_lines, base_failed and kept; lost has one row per row_key."""
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    both = stats.drop("line", "line_words").join(lost, "row_key", "left")
    both = both.withColumns({"lost_words": F.coalesce("lost_words", F.lit(0)).cast("long"), "lost_lines": F.coalesce("lost_lines", F.lit(0)).cast("long"), "base_failed": failed})
    return both.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("lost_words") >= rules.min_words))


def line_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of docs: doc_id, host, the base counts, base_failed, n_boilerplate_words, n_boilerplate_lines, kept."""
    stats = _stats(docs)
    lost = _lost_lines(stats, rules).groupBy("row_key").agg(F.sum("line_words").alias("lost_words"), F.count("*").alias("lost_lines"))
    return _judged(stats, lost, rules).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("lost_words").alias("n_boilerplate_words"), F.col("lost_lines").alias("n_boilerplate_lines"), "kept",
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Rows of docs that the rules keep, with all their columns and without their boilerplate lines."""
    stats = _stats(docs)
    lost = _lost_lines(stats, rules).groupBy("row_key").agg(F.sum("line_words").alias("lost_words"), F.count("*").alias("lost_lines"), F.collect_list("line").alias("lost"))  # at most the row's own lines
    marks = _judged(stats, lost, rules).filter("not kept or lost_lines > 0").select("text_key", "host", "kept", "lost").dropDuplicates(["text_key", "host"])
    text = F.coalesce(F.col("row.text"), F.lit(""))
    marked = carried(docs).withColumns({"text_key": _text_key(text), "host": _host(F.col("row.source"))}).join(marks, ["text_key", "host"], "left")

    def cut(batches: Batches) -> Batches:
        for b in slices(batches):
            own = zip(texts_in(b).to_pylist(), b.column("lost").to_pylist(), strict=True)
            yield retexted(b, [without_lines(t, set(x)) if x else t for t, x in own])

    return marked.filter("kept is null or kept").select("row", "lost").mapInArrow(cut, docs.schema)

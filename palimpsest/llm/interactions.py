"""Filter interaction audit: what each filter removes in every order of the filters, by windows over long-form mask cells.

One pass gives each document a mask of the filters that it fails. Documents then count in cells (part, mask), and the
cells are unpivoted against the steps of all orders: a running bit-or over the steps of an order tells what failed
earlier, conditional sums give the counts of a step, and a window over a part's filter adds up its removals of all orders.
After the first count nothing grows with the documents: a part has at most 2^filters cells.

Defined cases. Null text: empty, which fails A only (and E beside an empty text of a smaller doc_id). Null source: the
part of the empty string. Equal texts (by two 64-bit hashes and the length) fail E beyond the smallest doc_id; rows of that
same doc_id pass, and so do rows of null doc_id, which also make no other row fail. A doc_id with several labels has each
mark that any of them gives; null doc_ids have none. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches, as_bytes, checkpointed, rows_to_batch, slices

FILTERS = "ABCDE"
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


def failures(raw: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails: few words, few distinct words, many capitals, symbols."""
    words = raw.split()
    few, same = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 2 * n_chars
    return few | same << 1 | loud << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


_MASKS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("mask", pa.int32())])


def _masked(batches: Batches) -> Batches:
    for b in slices(batches):
        data, at = as_bytes(b.column("text"))
        sizes = b.column("size").to_pylist()
        masks = [failures(data[i:j].tobytes(), n) for i, j, n in zip(at[:-1].tolist(), at[1:].tolist(), sizes, strict=True)]
        yield rows_to_batch(_MASKS, [*(b.column(c) for c in ("doc_id", "part", "a", "b", "size")), masks])


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row of docs; bit i is set if filter i of FILTERS fails."""
    text = F.coalesce(docs["text"], F.lit(""))
    light = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.length(text).alias("size"), text.alias("text"))
    own = checkpointed(light.mapInArrow(_masked, "doc_id long, part string, a long, b long, size int, mask int"))
    # Minima combine before their shuffle; the join back may be split where one text is in a third of the rows.
    firsts = own.groupBy("a", "b", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("a", "b", "size", "first")
    later = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return own.join(firsts, ["a", "b", "size"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(later).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those with each mark."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = masks.join(marks, "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def order_metrics(table: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of every step of every order of the filters, from cells (part, mask, n, good, toxic); bit i of a mask is filter i.

    A part is at most 2^filters cells; it is dealt once, and all windows and sums keep to that.
    """
    letters = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    long = table.repartition("part").withColumn("filter_order", F.explode(letters)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    long = long.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("bit", F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i))), F.col("filter")))
    steps = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("own", F.col("mask").bitwiseAND(F.col("bit"))).withColumn("earlier", F.coalesce(F.bit_or("own").over(steps), F.lit(0)))
    removed, there = (F.col("own") != 0) & (F.col("earlier") == 0), F.col("earlier") == 0
    count = lambda rows, what="n": F.sum(F.when(rows, F.col(what)).otherwise(F.lit(0)))
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(there & (F.col("own") == 0)).alias("kept"), count(removed).alias("removed"), count((F.col("own") != 0) & ~there).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(removed, "good").alias("good_lost"), count(removed, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def interaction_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley and filter."""
    return order_metrics(cells(document_masks(docs), labels)).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter")


#: Each order walks by itself: the first filter of the order that a document fails removes it.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM d
), m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(toxic, false)) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY part, fails
), l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
w AS (SELECT *, contains(fails, filter) AS own, before <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN 'x' ELSE before END || ']') AS gone FROM x, s),
g AS (
  SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = filter), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (own AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM w GROUP BY part, filter_order, step, filter
)
SELECT *, CAST((SELECT sum(removed) FROM g h WHERE h.part = g.part AND h.filter = g.filter) AS BIGINT) AS shapley FROM g
"""

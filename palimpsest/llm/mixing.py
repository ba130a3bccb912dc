"""Mixing sources to target weights: words per source, repetition rates, whole copies and one seeded draw a document.

Sources in order of their names (code points, null last) weigh 1, 2, 3, repeating, and share the words of the whole
table; no target exceeds three times its source, and what is cut off is shared again by weight. A source's rate is its
target over its size: each document is emitted floor(rate) times, and once more if its draw falls below the rate's fraction.
A draw is the first 12 bits of an MD5 over doc_id, text and number, so reruns agree. Draws alone miss the target of a
source of few or very unequal documents by chance; so the bar on them is not the bare fraction but, from the words that
each of the 4096 draws would add, the value at which the words added come nearest to what the fraction asks for.

Only the words and a key of each document are shuffled, never a text: what a document needs is its own draw and its source's bar.

Defined cases. Null or empty text, or without words: size 0, taken 0. Null source: one source, the last. A source
without words: target 0. Rows repeated in source, doc_id and text are one document with a number of rows, each with a
draw of its own (so a hot null doc_id is not taken as a whole); `mixed` gives their copies the columns of one of them.
Empty table: no rows. Other columns are ignored by `mix_report` and kept by `mixed`. One row per source passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import carried, checkpointed

WORD = r"[^\x20\x09-\x0D]+"
CYCLE, MOST = 3, 3  #: weights 1 to CYCLE; a target is at most MOST times its source
DRAWS, RUN = 4096, 10_000  #: values of a draw; repeated rows unfolded at once
SMALL = 50_000  #: rows of a table of sources or repeated keys that is broadcast


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast where it has few rows; otherwise Spark joins it as it sees fit. df is checkpointed."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _draw(doc_id: Column, key: Column, number: Column) -> Column:
    seed = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), key, number.cast("string"))
    return F.conv(F.substring(F.md5(seed), 1, 3), 16, 10).cast("int")


def _units(docs: DataFrame) -> DataFrame:
    """source, doc_id, size, key and the rows that agree in them."""
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    light = docs.select(docs["source"].cast("string").alias("source"), docs["doc_id"].cast("long").alias("doc_id"), size.alias("size"), _key(docs["text"]).alias("key"))
    return checkpointed(light.groupBy("source", "doc_id", "size", "key").agg(F.count("*").alias("n")))


def _rows(units: DataFrame) -> DataFrame:
    """A row with its draw for each row of docs. Hot keys are dealt out before they unfold."""
    runs = units.filter(f"n > {RUN}").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    every = units.filter(f"n <= {RUN}").withColumn("run", F.lit(0).cast("long")).unionByName(runs.repartition("source", "doc_id", "key", "run"))
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    numbered = every.withColumn("number", F.explode(F.sequence(F.col("run") * RUN, last)))
    return numbered.select("source", "doc_id", "size", "key", _draw(F.col("doc_id"), F.col("key"), F.col("number")).alias("draw"))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    The level at which weight times level, cut at MOST times the size, adds up to the whole: with the sources in order of
    the level at which they are cut, it is the largest of the levels that the sources from each one on would share.
    """
    weighed = sizes.withColumn("weight", 1 + F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(CYCLE)))
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), ordered.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = weighed.withColumn("share", left.cast("double") / weights).withColumn("level", F.max("share").over(whole))
    return shared.select("source", "source_size", "weight", F.least((MOST * F.col("source_size")).cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _bars(units: DataFrame, calibrated: bool = True) -> DataFrame:
    """source, source_size, target, whole (copies of each document) and bar (draws below it add one more)."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(sizes).withColumn("whole", F.floor(rate)).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    if not calibrated:
        return checkpointed(plan.withColumn("bar", F.round((rate - F.col("whole")) * DRAWS).cast("int")))
    plan = checkpointed(plan)
    words = _rows(units).groupBy("source", "draw").agg(F.sum("size").alias("words"))  # at most DRAWS rows a source
    added = F.sum("words").over(Window.partitionBy("source").orderBy("draw"))
    steps = words.select("source", "draw", added.alias("added")).alias("s").join(_small(plan).alias("p"), F.expr("s.source <=> p.source"))
    steps = steps.select("p.source", "p.wanted", F.col("s.draw"), F.abs(F.col("s.added") - F.col("p.wanted")).alias("miss"))
    best = steps.groupBy("source").agg(F.min(F.struct("miss", "draw", "wanted")).alias("b"))
    found = best.select(F.col("source").alias("of"), F.when(F.col("b.miss") < F.col("b.wanted"), F.col("b.draw") + 1).otherwise(F.lit(0)).alias("bar"))
    return checkpointed(plan.join(found, F.expr("source <=> of"), "left").drop("of").withColumn("bar", F.coalesce("bar", F.lit(0))))


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("draw") < F.col("bar"), 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, calibrated: bool = True) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies; one row per row of docs.

    calibrated=False takes the fraction itself as the bar: draws are then independent, and sources of few documents farther from their target.
    """
    units = _units(docs)
    both = _rows(units).alias("r").join(_small(_bars(units, calibrated)).alias("s"), F.expr("r.source <=> s.source"))
    return both.withColumn("copies", _copies()).select("r.doc_id", "r.size", "s.source_size", "s.target", (F.col("r.size") * F.col("copies")).alias("taken"), F.col("r.source").alias("source"), "copies")


def mixed(docs: DataFrame, calibrated: bool = True) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    units = _units(docs)
    bars = _small(_bars(units, calibrated)).alias("s")
    source, doc_id = F.col("row.source").cast("string"), F.col("row.doc_id").cast("long")
    keyed = carried(docs).withColumns({"text_key": _key(F.col("row.text")), "of": source, "id": doc_id})
    same = F.expr("of <=> u.source and id <=> u.doc_id and text_key = u.key")
    twice, many = checkpointed(units.filter("n > 1").select("source", "doc_id", "key")), None
    if twice.limit(1).count():
        totals = _rows(units.filter("n > 1")).alias("r").join(bars, F.expr("r.source <=> s.source")).withColumn("copies", _copies())
        totals = totals.groupBy("r.source", "r.doc_id", "r.key").agg(F.sum("copies").alias("copies"))
        # One row stands for the rows that agree; candidates combine before the shuffle. Its copies unfold by runs, dealt out.
        stands = keyed.join(_small(twice).alias("u"), same, "left_semi").groupBy("of", "id", "text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        runs = stands.join(totals.alias("u"), same).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("copies") / RUN)))).withColumn("copies", F.least(F.col("copies") - F.col("run") * RUN, F.lit(RUN)))
        many = runs.select("row", "copies").filter("copies > 0")
        keyed = keyed.join(_small(twice).alias("u"), same, "left_anti")
    once = keyed.withColumn("draw", _draw(F.col("id"), F.col("text_key"), F.lit(0))).join(bars, F.expr("of <=> s.source")).select("row", _copies().alias("copies"))
    every = once if many is None else once.unionByName(many)
    return every.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: The same law over the same draws.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS key FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, key) - 1 AS number FROM d
), x AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || key || '|' || number), 1, 3) AS INTEGER) AS draw FROM r
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} AS weight FROM x GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS share
  FROM s WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, least(CAST({MOST} * source_size AS DOUBLE), weight * (SELECT max(share) FROM l)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
a AS (
  SELECT p.source, draw, abs(CAST(added AS DOUBLE) - (target - whole * source_size)) AS miss, target - whole * source_size AS wanted
  FROM (SELECT source, draw, sum(sum(size)) OVER (PARTITION BY source ORDER BY draw) AS added FROM x GROUP BY source, draw) w JOIN p ON w.source IS NOT DISTINCT FROM p.source
), b AS (SELECT source, CASE WHEN min(miss) < any_value(wanted) THEN arg_min(draw, (miss, draw)) + 1 ELSE 0 END AS bar FROM a GROUP BY source)
SELECT x.doc_id, x.size, p.source_size, p.target, CAST(x.size * (p.whole + CASE WHEN x.draw < b.bar THEN 1 ELSE 0 END) AS BIGINT) AS taken, x.source,
       CAST(p.whole + CASE WHEN x.draw < b.bar THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source JOIN b ON x.source IS NOT DISTINCT FROM b.source
"""

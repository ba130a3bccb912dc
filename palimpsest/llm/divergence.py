"""Source divergence audit: sketch-prefiltered counting of terms, then sparse joins of pairs of sources.

1. Each task counts, per language and term, its documents in a count-min sketch. Counters stop at `min_docs`, so sums of
   sketches stop there too and never underestimate what matters; they are merged block by block in a stream.
2. A term with any counter below `min_docs` cannot be in that many documents. All others are counted exactly per (lang,
   source), and those in `min_docs` documents of their language are kept.
3. Every group gives each of the V kept terms p = 1 + floor(10^9 (count + 2) / (N + 2 V)), in decimals; f(p, q) is the
   floored (p - q)^2 / (p + q). Over all V terms, the sum for two sources is that of two sources without terms, plus what
   each one's own terms change (by its counts' histogram), plus what the terms of both change (the join on the term).

The sketch is `depth` rows of 2^width_bits counters (16 MB a task by default, 32 times less as the bits that are sent back
to the tasks), whatever the size of the input; more distinct terms than it can tell apart only let more terms through.

Defined cases. Null text, lang and source: ''. Texts without a term, groups and languages without kept terms: the pairs
of their sources are there, with 0 where V is 0. Repeated rows count by themselves. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import GOLDEN, U64, Batches, as_bytes, checkpointed, mix, rows_to_batch, slices

MIN_DOCS, TOP, WIDTH_BITS, DEPTH = 10, 10, 20, 4
BLOCK, PIECE, MERGERS = 4096, 8 << 20, 16  #: counters of a block that is merged; bytes of texts split at once; tasks for a block in the first merge
GROUPS = 50_000  #: groups that are broadcast
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def cuts_of(plain: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of parts of up to about PIECE bytes, cut at spaces, of the rows of a folded text buffer, and the row of each part."""
    long = np.flatnonzero(np.diff(at) > PIECE)
    if not len(long):
        return at, np.arange(len(at) - 1)
    more = []
    for i in long.tolist():
        cut = int(at[i]) + PIECE
        while cut < at[i + 1] and (cut := plain.find(b" ", cut, int(at[i + 1]))) >= 0:
            more.append(cut)
            cut += PIECE
    own = np.sort(np.concatenate((at, np.array(more, np.int64))))
    return own, np.searchsorted(at, own[:-1], side="right") - 1


def counted(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of the rows of a buffer in UTF-8, and for each (row, term) the row, the term's place and its occurrences."""
    plain = data.tobytes().translate(_FOLD)
    own, rows = cuts_of(plain, at)
    found: list[tuple[np.ndarray, ...]] = []
    terms: list[pa.Array] = []
    first = 0
    while first < len(rows):  # a long text goes part by part
        last = max(first + 1, int(np.searchsorted(own, own[first] + PIECE, side="right")) - 1)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(own[first : last + 1].astype(np.int64)), pa.py_buffer(plain)])
        parts = pc.ascii_split_whitespace(column.cast(pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        cell, n = np.unique(rows[first + pc.list_parent_indices(parts).to_numpy()] * size + coded.indices.to_numpy(), return_counts=True)
        terms.append(coded.dictionary)
        found.append((*np.divmod(cell, size), n))
        first = last
    if len(terms) > 1:  # parts of one text may share terms
        names = pa.concat_arrays(terms).dictionary_encode()
        place = np.split(names.indices.to_numpy().astype(np.int64), np.cumsum([len(t) for t in terms])[:-1])
        row, term, n = (np.concatenate(x) for x in zip(*((r, p[t], n) for (r, t, n), p in zip(found, place, strict=True)), strict=True))
        cell, back = np.unique(row * len(names.dictionary) + term, return_inverse=True)
        terms, found = [names.dictionary], [(*np.divmod(cell, len(names.dictionary)), np.bincount(back, n, len(cell)).astype(np.int64))]
    if not terms:
        return pa.array([], pa.large_string()), *(np.empty(0, np.int64),) * 3
    (names,), ((row, term, n),) = terms, found
    there = np.asarray(pc.not_equal(names, ""))[term]  # the split gives empty strings at the ends of a text
    return names, row[there], term[there], n[there]


def _slice(b: pa.RecordBatch, keys: list[str]) -> tuple[list[tuple], pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and terms of a slice, and for each (group, term) their numbers, occurrences and documents."""
    groups: dict[tuple, int] = {}
    owner = np.array([groups.setdefault(k, len(groups)) for k in zip(*(b.column(c).to_pylist() for c in keys), strict=True)], np.int64)
    names, row, term, n = counted(*as_bytes(b.column("text")))
    size = max(1, len(names))
    cell, back = np.unique(owner[row] * size + term, return_inverse=True) if len(row) else (np.empty(0, np.int64),) * 2
    return list(groups), names, *np.divmod(cell, size), np.bincount(back, n, len(cell)).astype(np.int64), np.bincount(back, minlength=len(cell))


def _hashes(langs: list[str], terms: pa.Array, lang: np.ndarray, term: np.ndarray) -> np.ndarray:
    """64-bit hashes of (language, term)."""
    of_lang = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in langs], np.uint64)
    of_term = np.fromiter(map(xxhash.xxh64_intdigest, terms.cast(pa.large_binary()).to_pylist()), np.uint64, len(terms))
    return mix(of_lang[lang] * GOLDEN + of_term[term]) if len(term) else np.empty(0, np.uint64)


def places(h: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    """Counter of each hash in a row of the sketch."""
    return (((h & U64(0xFFFFFFFF)) + U64(row) * ((h >> U64(32)) | U64(1))) & U64((1 << width_bits) - 1)).astype(np.int64)


_BLOCKS = pa.schema([("block", pa.int32()), ("counters", pa.binary())])


def _packed(counters: np.ndarray) -> bytes:
    """A block as it is, or as places and values where few counters are set."""
    at = np.flatnonzero(counters)
    return counters.tobytes() if 2 * len(at) >= BLOCK else (at.astype(np.uint32) << 16 | counters[at]).astype(np.uint32).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == 2 * BLOCK:
        return np.frombuffer(raw, np.uint16)
    out, x = np.zeros(BLOCK, np.uint16), np.frombuffer(raw, np.uint32)
    out[x >> 16] = x & 0xFFFF
    return out


def _sent(blocks: dict[int, np.ndarray]) -> Batches:
    every = list(blocks.items())
    for i in range(0, len(every), 128):
        yield rows_to_batch(_BLOCKS, [[k for k, _ in every[i : i + 128]], [_packed(x) for _, x in every[i : i + 128]]])


def _sketched(least: int, width_bits: int, depth: int):
    def run(batches: Batches) -> Batches:
        sketch = np.zeros((depth, 1 << width_bits), np.uint32)  # a task has fewer rows than would overflow it
        for b in slices(batches, rows=1 << 20, most=PIECE):
            langs, terms, group, term, _, docs = _slice(b, ["lang"])
            h = _hashes([x[0] for x in langs], terms, group, term)
            for d in range(depth):
                np.add.at(sketch[d], places(h, d, width_bits), docs.astype(np.uint32))
        blocks = np.minimum(sketch, least).astype(np.uint16).reshape(-1, BLOCK)
        yield from _sent({k: blocks[k] for k in np.flatnonzero(blocks.any(axis=1)).tolist()})

    return run


def _merged(least: int):
    def run(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}  # at most the blocks of one sketch
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("counters").to_pylist(), strict=True):
                sums[k] = np.minimum(sums[k] + _unpacked(raw), least).astype(np.uint16) if k in sums else _unpacked(raw)
        yield from _sent(sums)

    return run


def sketch_of(rows: DataFrame, min_docs: int = MIN_DOCS, width_bits: int = WIDTH_BITS, depth: int = DEPTH) -> np.ndarray:
    """Merged document frequencies of (lang, term), each up to min_docs: depth x 2^width_bits counters. rows: lang, text."""
    least = min(min_docs, 30_000)
    own = rows.select("lang", "text").mapInArrow(_sketched(least, width_bits, depth), "block int, counters binary")
    some = own.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGERS))).repartition("block", "salt").select("block", "counters").mapInArrow(_merged(least), "block int, counters binary")
    out = np.zeros((depth << width_bits) // BLOCK * BLOCK, np.uint16).reshape(-1, BLOCK)
    for k, raw in some.repartition("block").mapInArrow(_merged(least), "block int, counters binary").toLocalIterator():  # depth x 2^width_bits counters at most
        out[k] = _unpacked(bytes(raw))
    return out.reshape(depth, -1)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _survivors(bits: bytes, width_bits: int, depth: int):
    """Counts of the terms that have all their bits set: those that the sketch cannot rule out."""

    def run(batches: Batches) -> Batches:
        there = np.frombuffer(bits, np.uint8)
        for b in slices(batches, rows=1 << 20, most=PIECE):
            groups, terms, group, term, n, docs = _slice(b, ["lang", "source"])
            h = _hashes([g[0] for g in groups], terms, group, term)
            stay = np.ones(len(h), bool)
            for d in range(depth):
                at = places(h, d, width_bits) + (d << width_bits)
                stay &= (there[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            group, term = pa.array(group[stay]), pa.array(term[stay])
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            yield rows_to_batch(_COUNTS, [langs.take(group), sources.take(group), terms.take(term).cast(pa.string()), n[stay], docs[stay]])

    return run


def kept_counts(rows: DataFrame, min_docs: int = MIN_DOCS, width_bits: int = WIDTH_BITS, depth: int = DEPTH) -> DataFrame:
    """lang, source, term, n (occurrences in the group) and total (in the language), for the terms in at least min_docs documents of their language."""
    sketch = sketch_of(rows, min_docs, width_bits, depth)
    bits = np.packbits(sketch >= min(min_docs, 30_000)).tobytes()
    counts = checkpointed(rows.mapInArrow(_survivors(bits, width_bits, depth), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= min_docs).select("lang", "term", "total")
    return checkpointed(counts.drop("docs").join(terms, ["lang", "term"]))


def _p(n: str, total: str, v: str = "v") -> Column:
    return F.expr(f"1 + cast(1000000000 * cast({n} + 2 as decimal(28, 0)) div greatest(cast({total} + 2 * {v} as decimal(28, 0)), 1) as long)")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence_report(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, width_bits: int = WIDTH_BITS, depth: int = DEPTH) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_counts(rows, min_docs, width_bits, depth)
    langs = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["v", "group_n", "lang_n"])
    groups = checkpointed(groups.withColumn("p0", _p("0", "group_n")))
    few = F.broadcast(groups) if groups.count() <= GROUPS else groups
    seen = checkpointed(kept.join(few, ["lang", "source"]).withColumn("p", _p("n", "group_n")).withColumn("q", _p("total", "lang_n")).select("lang", "source", "term", "n", "p", "p0", "q"))

    value, low, high = F.col("value").cast("long").alias("value"), F.least("a.source", "b.source").alias("low"), F.greatest("a.source", "b.source").alias("high")
    two = groups.alias("a").join(few.alias("b"), F.expr("a.lang = b.lang and a.source < b.source")).select("a.lang", low, high, (F.col("a.v") * _f("a.p0", "b.p0")).alias("value"))
    sizes = seen.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    alone = sizes.alias("a").join(few.alias("b"), F.expr("a.lang = b.lang and a.source <> b.source")).select("a.lang", low, high, (F.col("a.terms") * (_f("a.p", "b.p0") - _f("a.p0", "b.p0"))).alias("value"))
    change = _f("a.p", "b.p") - _f("a.p", "b.p0") - _f("a.p0", "b.p") + _f("a.p0", "b.p0")
    shared = seen.alias("a").join(seen.alias("b"), F.expr("a.lang = b.lang and a.term = b.term and a.source < b.source")).select("a.lang", F.col("a.source").alias("low"), F.col("b.source").alias("high"), change.alias("value"))
    pairs = two.unionByName(alone).unionByName(shared).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    both = pairs.withColumn("end", F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "end.source", F.lit("pair").alias("part"), "end.item", value).withColumn("rank", F.row_number().over(ranked))
    term = seen.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pair.unionByName(term)


#: Every group against every kept term of its language, in 128-bit integers.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (sum(total) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q FROM a
), x AS (
  SELECT l.lang, l.source, r.source AS item, sum((l.p - r.p) * (l.p - r.p) // (l.p + r.p)) AS value FROM p l JOIN p r ON l.lang = r.lang AND l.term = r.term AND l.source <> r.source GROUP BY ALL
), pair AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
), every AS (
  SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 10
"""

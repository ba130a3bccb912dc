"""Keyword index and BM25 ranking over chunks, for many queries in one job.

The index is one table of postings: term, chunk_id, dl (terms of the chunk) and positions, one row per term of a chunk, and
per chunk one row of the empty term that carries its length. It is built in one pass in Arrow batches without a
shuffle. Kept in a folder dealt by term, a search reads the parts of its terms only; chunks are added by appending their
postings and removed with them, so statistics are always those of the chunks that are there.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.arrow import slices
from palimpsest.functions.stem import stem as stem_of
from palimpsest.functions.stem import stemmed
from palimpsest.functions.text import ACCENTED, PLAIN, terms
from palimpsest.operators.store import settled

#: Fixed values of the ranking.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
ASKED = 20_000  #: different terms of queries that are sent to the tasks
LENGTH = ""  #: the term of the rows that carry a chunk's length
_TERM = re.compile("(?:[^\\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+")
_FOLDED = str.maketrans(ACCENTED, PLAIN)


def terms_of(text: str | None) -> list[str]:
    """As `functions.text.terms`, of a Python string."""
    return _TERM.findall(text.lower().translate(_FOLDED)) if text else []


_POSTINGS = [("term", pa.string()), ("dl", pa.int64()), ("positions", pa.list_(pa.int32()))]


def postings(chunks: DataFrame, stem: bool = False, only: frozenset[str] | None = None) -> DataFrame:
    """The index of chunks (chunk_id, content and, if it is there, document_id). Tasks stem as they go, each remembering its words.

    only: the terms to keep besides the lengths, so that no others leave the tasks.
    """
    keys = [c for c in ("chunk_id", "document_id") if c in chunks.columns]
    kinds = dict(chunks.dtypes)

    def run(batches):
        for b in slices(batches):
            rows, term, dl, places = [], [], [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                found: dict[str, list[int]] = {LENGTH: []}
                own = [stem_of(t) for t in terms_of(text)] if stem else terms_of(text)
                for at, t in enumerate(own):
                    if only is None or t in only:
                        found.setdefault(t, []).append(at)
                rows += [i] * len(found)
                dl += [len(own)] * len(found)
                term += found
                places += found.values()
            at = pa.array(rows, pa.int64())
            columns = [*(b.column(c).take(at) for c in keys), *(pa.array(x, t) for x, (_, t) in zip((term, dl, places), _POSTINGS, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *(n for n, _ in _POSTINGS)])

    return chunks.select(*keys, "content").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", term string, dl long, positions array<int>")


def term_counts(index: DataFrame) -> DataFrame:
    """term, chunk_id, tf."""
    return index.filter(F.col("term") != LENGTH).select("term", "chunk_id", F.size("positions").cast("long").alias("tf"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n_chunks, avgdl over all chunks."""
    return index.filter(F.col("term") == LENGTH).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def query_words(query: Column) -> Column:
    """Words of a query after sanitising: operators and special characters out, at most 20."""
    clean = F.regexp_replace(query, r"[*?(){}\[\]^:=!@#%&\\~]", " ")
    clean = F.regexp_replace(clean, r"(?i)(?<![\p{L}\p{N}_])(AND|OR|NOT|NEAR)(?![\p{L}\p{N}_])", " ")
    return F.slice(F.filter(F.split(clean, r"[ \t\n\r\x0B\x0C]+"), lambda w: w != ""), 1, 20)


def match_expression(query: Column) -> Column:
    """The sanitised query in quoted form; two quotes for none."""
    words = F.transform(query_words(query), lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(words) > 0, F.array_join(words, " OR ")).otherwise(F.lit('""'))


def phrases(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, phrase, offset, size, term) of queries (query_id, query); a word with inner punctuation is a phrase of several terms."""
    words = queries.select("query_id", F.posexplode(query_words(F.col("query"))).alias("phrase", "word")).withColumn("parts", terms(F.col("word")))
    out = words.select("query_id", "phrase", F.size("parts").alias("size"), F.posexplode("parts").alias("offset", "term"))
    return out.withColumn("term", stemmed("term")) if stem else out


def ranked(index: DataFrame, queries: DataFrame, k: int = 20, allowed: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """query_id, chunk_id, rank (negative; less is better), place (1 to k). Ties go to the smaller chunk_id.

    index: postings, stored or not (stem: made with stem). allowed: the chunk_ids that may be returned; statistics are
    over all chunks all the same. Words of one term need no positions; only phrases of several are grouped for them.
    """
    asked = phrases(queries, stem)
    found = index.filter(F.col("term") != LENGTH).join(asked, "term")
    words = found.filter("size = 1").select("query_id", "phrase", "chunk_id", "dl", F.size("positions").alias("tf"))
    starts = F.collect_list(F.transform("positions", lambda x: x - F.col("offset"))).alias("starts")  # a phrase's terms at most
    longer = found.filter("size > 1").groupBy("query_id", "phrase", "size", "chunk_id", "dl").agg(starts).filter(F.size("starts") == F.col("size"))
    shared = F.aggregate(F.slice("starts", 2, F.size("starts")), F.col("starts")[0], F.array_intersect)
    tf = words.unionByName(longer.select("query_id", "phrase", "chunk_id", "dl", F.size(shared).alias("tf")).filter("tf > 0"))
    n = tf.groupBy("query_id", "phrase").agg(F.count("*").alias("n"))
    scored = tf.join(n, ["query_id", "phrase"]).join(F.broadcast(corpus_stats(index)))  # one row
    raw = F.log((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))
    score = -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    ranks = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum(score), 9).alias("rank"))
    if allowed is not None:
        ranks = ranks.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    return ranks.withColumn("place", place).filter(F.col("place") <= k)


def asked_postings(chunks: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """The postings of the queries' terms and of the lengths, settled: one pass over the chunks where no index is kept.

    Up to ASKED different terms (or stems) go to the tasks, which keep no others; more are joined after.
    """
    wanted = phrases(queries, stem).select("term").distinct()
    few = [r[0] for r in wanted.limit(ASKED + 1).collect()]
    if len(few) <= ASKED:
        return settled(postings(chunks, stem, frozenset(few)))
    return settled(postings(chunks, stem).join(wanted.unionByName(queries.sparkSession.createDataFrame([(LENGTH,)], "term string")), "term", "left_semi"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 20, allowed: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """As `ranked`, of chunks without an index."""
    return ranked(asked_postings(chunks, queries, stem), queries, k, allowed, stem)


def normalised(ranks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: best returned row 1, worst 0, all 1 where they are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("rank").over(w), F.max("rank").over(w)
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return ranks.select("query_id", "chunk_id", (1 - (F.col("rank") - low) / width).alias("score"))

"""Registered queries over the driver's tables; their SQL is in oracle.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.config import Settings
from palimpsest.functions import text as tx
from palimpsest.operators import answer, chunk, graph, keyword, observe, parse, protect, recall, redact, vector
from palimpsest.operators.index import KeywordIndex
from palimpsest.operators.store import checkpoint_folder, settled
from palimpsest.plans import oracle
from palimpsest.sources import capture, files
from palimpsest.sources.corpus import AS_OF, corpus, table
from palimpsest.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _time(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(corpus(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: each benchmark text whose id is divisible by 20, with the vector of that id where there is one."""
    rows = table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows.join(vectors, "query_id", "left")


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("id"), "embedding", F.col("label").cast("long").alias("label"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mentions(corpus(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"), (start + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))).alias("created_at"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("fts_search_p95_ms", "vector_search_p95_ms", "hybrid_retrieval_p95_ms", "forget_single_doc_ms")))
    return table(spark, sf_dir, "events").select(F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("metric"), "value", "ts", F.col("event_id").alias("seq"))


def _search(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    pieces, rows = settled(_chunks(spark, sf_dir)), settled(_mentions(spark, sf_dir))  # read more than once
    return recall.hybrid_search(corpus(spark, sf_dir), pieces, _asked(spark, sf_dir), AS_OF, rows, _vectors(spark, sf_dir), **options)


def _result(rows: DataFrame) -> DataFrame:
    scores = [F.round(c, 6).alias(c) for c in ("combined_score", "vector_score", "keyword_score", "graph_score", "temporal_score")]
    return rows.select("query_id", "citation_index", "chunk_id", "document_id", "source_type", "source_path", _time("captured_at"), *scores)


# Capture and identity


@query
def doc_dedup(spark, sf_dir):
    return protect.first_of_checksum(corpus(spark, sf_dir)).select("document_id", "checksum")


@query
def dedup_decision(spark, sf_dir):
    states = F.array(*map(F.lit, oracle.STATES))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.try_element_at(states, (F.col("doc_id") % 9 + 1).cast("int")).alias("status"), (F.col("doc_id") % 7).alias("retry_count"))
    return rows.select("document_id", "status", protect.arrival_decision(F.col("status"), F.col("retry_count")).alias("decision"))


@query
def browser_allowed(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", capture.host(F.col("url")).alias("host"))
    return rows.filter(~capture.is_excluded(F.col("host"), config.EXCLUDED_DOMAINS + oracle.MORE_DOMAINS)).select("page_id", "host")


@query
def browser_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", parse.html_title(F.col("html")).alias("title"), F.lit(AS_OF).alias("visited_at"), F.lit("chrome").alias("browser"))
    return capture.browser_documents(rows).select("source_path", "content", "checksum", F.col("source_metadata")["title"].alias("title"), "priority")


@query
def login_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", capture.is_login_page(F.concat("html", F.when(F.col("page_id") % 3 == 0, F.lit("<FORM><input name=Password>")).otherwise(F.lit("")))).alias("login"))


@query
def history_commands(spark, sf_dir):
    rows = corpus(spark, sf_dir).filter("source_type = 'terminal'")
    text = F.concat(F.lit(": 1700000000:0;"), F.replace("body", F.lit(", "), F.lit("\n\n: 1700000001:0;")))
    return capture.terminal_documents(rows.select(F.col("source_path").alias("path"), text.alias("history"), "captured_at")).select("content", "checksum", F.col("source_metadata")["preview"].alias("preview"))


@query
def clipboard_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("stream"), "event_id", "event_type")
    return capture.clipboard_changes(rows, "stream", "event_id", "event_type").select("stream", "event_id", "event_type", "checksum")


@query
def queue_admission(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).cast("long").alias("batch"), (F.col("event_id") % 4).alias("priority"))
    return ingest.dequeue_order(ingest.admit(rows, capacity=500, arrival="event_id", part="batch"), "batch", "priority", "event_id").select("batch", "event_id", "priority", "queue_position")


@query
def queue_drops(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).cast("long").alias("batch"))
    return ingest.admit(rows, capacity=500, arrival="event_id", part="batch").groupBy("batch").agg(F.count_if(~F.col("admitted")).alias("dropped"), F.count_if("admitted").alias("depth"))


# Parsing


@query
def content_type_detect(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    path = F.when(F.col("document_id") % 5 == 0, F.concat(F.lit("notes/"), F.col("document_id").cast("string"))).otherwise(F.col("source_path"))
    text = F.when(F.col("document_id") % 10 == 0, F.concat(F.lit("%PDF"), F.col("text"))).when(F.col("document_id") % 10 == 5, F.concat(F.lit("<p>"), F.col("text"))).otherwise(F.col("text"))
    return docs.select("document_id", parse.content_type(parse.file_name(path), text).alias("content_type"), parse.language(parse.file_name(path)).alias("language"))


@query
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parse.html_title(F.col("html")).alias("title"), parse.html_text(F.col("html")).alias("clean_content"))


@query
def pdf_clean(spark, sf_dir):
    text = parse.pdf_clean(F.replace("body", F.lit(" "), F.lit("  ")))
    return corpus(spark, sf_dir).select("document_id", text.alias("clean_content"), parse.pdf_pages(text).alias("page_count"))


@query
def code_symbols(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    text = F.concat(F.lit("def alpha(x):\n"), F.lit('    """about alpha"""\nasync def beta():\n  pass\nclass Gamma:\n'), F.col("text"))
    lang = F.when(F.col("document_id") % 2 == 0, "python").otherwise("go")
    return docs.select("document_id", F.array_join(parse.code_symbols(text, lang), ",").alias("symbols"), F.array_join(parse.code_docs(text, lang), "|").alias("docs"), parse.line_count(text).alias("line_count"))


@query
def word_char_count(spark, sf_dir):
    return corpus(spark, sf_dir).select("document_id", tx.word_count(F.col("text")).alias("word_count"), F.length("text").cast("long").alias("char_count"))


@query
def email_parse(spark, sf_dir):
    mail = F.concat(F.lit("Subject: note "), F.col("document_id").cast("string"), F.lit("\nFrom: a@example.org\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n\n"), F.col("text"))
    return corpus(spark, sf_dir).select("document_id", parse.email_text(mail).alias("clean_content"))


@query
def markdown_parse(spark, sf_dir):
    return corpus(spark, sf_dir).select("document_id", parse.markdown_text(F.concat(F.lit("# Title\n\n**bold** [link](http://x)\n"), F.col("body"))).alias("clean_content"))


# Redaction


def _secretive(spark, sf_dir):
    suffixes = F.array(*(F.lit(" " + s) for s in config.REDACTION_FIXTURES))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.col("text"), F.element_at(suffixes, (F.col("doc_id") % 7 + 1).cast("int"))).alias("text"))


@query
def redact_patterns(spark, sf_dir):
    return _secretive(spark, sf_dir).select("document_id", redact.redact_patterns(F.col("text")).alias("redacted"))


@query
def redact_counts(spark, sf_dir):
    return _secretive(spark, sf_dir).select("document_id", *(c.alias(n) for n, c in redact.pattern_counts(F.col("text")).items()))


@query
def redact_entropy(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" token= "), F.sha2("text", 256), F.lit("QwErTyUiOpZxCvBnM"), F.lit(" end"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), redact.redact_entropy(text).alias("redacted"))


@query
def entropy_runs(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" "), F.sha2("text", 256))
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(redact.entropy_runs(text)).alias("position", "run"))
    return runs.select("document_id", F.col("position").cast("long").alias("position"), "run", F.round(tx.entropy(F.col("run")), 6).alias("entropy"))


# Chunking


@query
def chunk_prose(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query
def chunk_email(spark, sf_dir):
    return chunk.chunks(corpus(spark, sf_dir).withColumn("kind", F.lit("email")), kind="kind")


@query
def chunk_code(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("code", F.replace("text", F.lit("\n"), F.lit("\ndef "))).withColumn("kind", F.lit("code"))
    return chunk.chunks(docs, "code", "kind")


@query
def chunk_stats(spark, sf_dir):
    rows = _chunks(spark, sf_dir).join(corpus(spark, sf_dir).select("document_id", "source_type"), "document_id")
    return rows.groupBy("source_type").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.max("total_chunks").alias("most"))


# Keyword index


@query
def token_postings(spark, sf_dir):
    return keyword.term_counts(keyword.postings(_chunks(spark, sf_dir)))


@query
def corpus_stats(spark, sf_dir):
    return keyword.corpus_stats(keyword.postings(_chunks(spark, sf_dir))).select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query
def fts_sanitise(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(' AND (x:y) "q" not near*'))
    return table(spark, sf_dir, "benchmark").select("item_id", keyword.match_expression(text).alias("expression"))


@query
def bm25_topk(spark, sf_dir):
    return keyword.bm25(_chunks(spark, sf_dir), _asked(spark, sf_dir)).select("query_id", "chunk_id", F.round("rank", 6).alias("rank"), F.col("place").cast("long").alias("place"))


@query
def keyword_norm(spark, sf_dir):
    return keyword.normalised(keyword.bm25(_chunks(spark, sf_dir), _asked(spark, sf_dir))).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query
def phrase_search(spark, sf_dir):
    pairs = F.regexp_replace("query", "([A-Za-z]+) ([A-Za-z]+)", "$1-$2")
    return keyword.bm25(_chunks(spark, sf_dir), _asked(spark, sf_dir).withColumn("query", pairs), 50).select("query_id", "chunk_id", F.round("rank", 6).alias("rank"))


@query
def bm25_stemmed(spark, sf_dir):
    return keyword.bm25(_chunks(spark, sf_dir), _asked(spark, sf_dir), 20, stem=True).select("query_id", "chunk_id", F.round("rank", 6).alias("rank"))


_STANDING: dict[tuple[str, str], dict] = {}


def _standing_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a memory keeps it, written when it is first asked for."""
    out = _STANDING.setdefault((spark.sparkContext.applicationId, sf_dir), {"path": f"{checkpoint_folder(spark)}/standing-{uuid.uuid4()}"})
    if name not in out:
        rows = {"docs": lambda: corpus(spark, sf_dir).select("document_id", "source_type", "source_path", "captured_at"), "chunks": lambda: _chunks(spark, sf_dir), "mentions": lambda: _mentions(spark, sf_dir), "vectors": lambda: _vectors(spark, sf_dir)}[name]()
        rows.write.option("compression", "zstd").parquet(f"{out['path']}/{name}")
        out[name] = spark.read.parquet(f"{out['path']}/{name}")
    return out[name]


def standing(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ()) -> dict:
    """The keyword index, and the named ones of docs, chunks, mentions and vectors, as a memory keeps them: built once for a session and a folder.

    The index has had additions, deletions and a compaction: documents in three batches, a tenth of them deleted and added again.
    """
    chunks = _standing_table(spark, sf_dir, "chunks")
    out = _STANDING[spark.sparkContext.applicationId, sf_dir]
    if "index" not in out:
        index, rest = KeywordIndex(spark, f"{out['path']}/index"), F.pmod("document_id", F.lit(10))
        first, second, third = (index.append(chunks.filter(batch)) for batch in (rest < 5, rest == 5, rest > 5))
        index.forget(chunks.filter(rest == 7).withColumn("segment", F.lit(third).cast("long")))
        index.compact([first, second])
        index.append(chunks.filter(rest == 7))
        out["index"] = index
    for name in tables:
        _standing_table(spark, sf_dir, name)
    return out


@query
def stored_bm25(spark, sf_dir):
    """As bm25_topk, from the stored index."""
    return standing(spark, sf_dir)["index"].search(_asked(spark, sf_dir)).select("query_id", "chunk_id", F.round("rank", 6).alias("rank"), F.col("place").cast("long").alias("place"))


@query
def stored_phrases(spark, sf_dir):
    """As phrase_search, from the stored index."""
    pairs = F.regexp_replace("query", "([A-Za-z]+) ([A-Za-z]+)", "$1-$2")
    return standing(spark, sf_dir)["index"].search(_asked(spark, sf_dir).withColumn("query", pairs), 50).select("query_id", "chunk_id", F.round("rank", 6).alias("rank"))


@query
def stored_hybrid(spark, sf_dir):
    """As hybrid_search, from stored tables."""
    t = standing(spark, sf_dir, ("docs", "mentions", "vectors"))
    return _result(recall.hybrid_search(t["docs"], t["chunks"], _asked(spark, sf_dir), AS_OF, t["mentions"], t["vectors"], ranked=t["index"].search))


# Vectors


@query
def cosine_topk(spark, sf_dir):
    return vector.nearest(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir)).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query
def vector_where(spark, sf_dir):
    return vector.nearest(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), 10, F.col("label") == 1).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query
def lsh_topk(spark, sf_dir):
    return vector.lsh_nearest(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), 10)


@query
def migration_progress(spark, sf_dir):
    return vector.migration_progress(_chunks(spark, sf_dir), _vectors(spark, sf_dir))


@query
def embed_chunks(spark, sf_dir):
    return vector.embedded(_chunks(spark, sf_dir), "hashing", "1").select("chunk_id", "embedding", "embed_model", "embed_model_version")


# Entities and graph


@query
def query_entities(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(graph.entity_names(F.col("text"))).alias("name"))


@query
def entity_rollup(spark, sf_dir):
    return graph.rollup(_mentions(spark, sf_dir)).select("canonical_name", "entity_type", _time("first_seen"), _time("last_seen"), "mention_count")


@query
def entity_upsert(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    old, new = (graph.rollup(rows.filter(F.col("document_id") % 2 == k)) for k in (0, 1))
    return graph.upsert(old, new).select("canonical_name", "entity_type", _time("first_seen"), _time("last_seen"), "mention_count")


@query
def entity_search(spark, sf_dir):
    return graph.search(graph.rollup(_mentions(spark, sf_dir)), "TION", limit=50).select("canonical_name", "entity_type", "mention_count")


@query
def entity_top(spark, sf_dir):
    return graph.top(graph.rollup(_mentions(spark, sf_dir))).select("canonical_name", "mention_count")


def _names(spark, sf_dir):
    """The names of the query set."""
    return _asked(spark, sf_dir).select("query_id", F.explode(graph.entity_names(F.col("query"))).alias("name"))


def _changes(spark, sf_dir) -> list[tuple[DataFrame, int]]:
    """Mentions and signs of three changes over all documents: two additions, and a deletion of the ids that leave 2 when divided by 5."""
    rows, fifth = settled(_mentions(spark, sf_dir)), F.pmod("document_id", F.lit(5))
    return [(rows.filter(fifth < 3), 1), (rows.filter(fifth >= 3), 1), (rows.filter(fifth == 2), -1)]


@query
def stored_entities(spark, sf_dir):
    """Entities after additions and a deletion, from counts kept by difference."""
    first, second, (gone, sign) = _changes(spark, sf_dir)
    left = first[0].unionByName(second[0]).filter(F.pmod("document_id", F.lit(5)) != 2)
    names = settled(graph.name_deltas(*first).withColumn("at", F.lit(1)).unionByName(graph.name_deltas(*second).withColumn("at", F.lit(2))))
    less = settled(graph.name_deltas(gone, sign))
    names = names.unionByName(less.unionByName(graph.resets(graph.entities_of(names), less, left)).withColumn("at", F.lit(3)))
    return graph.entities_of(names).select("canonical_name", "entity_type", _time("first_seen"), _time("last_seen"), "mention_count")


@query
def stored_relations(spark, sf_dir):
    """Relations after additions and a deletion, from counts kept by difference."""
    return graph.relations_after(_changes(spark, sf_dir)).select("subject", "object", "n_documents", F.round("confidence", 6).alias("confidence"))


@query
def graph_neighbors(spark, sf_dir):
    return graph.neighbours(_names(spark, sf_dir), _mentions(spark, sf_dir))


@query
def graph_2hop(spark, sf_dir):
    rows = settled(_mentions(spark, sf_dir))
    seeds = rows.filter(F.col("document_id") % 20 == 0).select(F.col("document_id").alias("query_id"), "name")
    return graph.neighbours(seeds, rows, 2)


@query
def graph_nodes(spark, sf_dir):
    return graph.nodes(corpus(spark, sf_dir), _chunks(spark, sf_dir), _mentions(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query
def graph_edges(spark, sf_dir):
    rows = settled(_mentions(spark, sf_dir))
    found = graph.edges(_chunks(spark, sf_dir), rows, graph.cooccurrences(rows))
    return found.groupBy("kind", "src").agg(F.count("*").alias("n"), F.min("dst").alias("least"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query
def graph_forget(spark, sf_dir):
    rows, pieces = settled(_mentions(spark, sf_dir)), settled(_chunks(spark, sf_dir))
    gone = corpus(spark, sf_dir).filter("source_type = 'browser'")
    return graph.without_documents(graph.edges(pieces, rows), pieces, gone).groupBy("kind").agg(F.count("*").alias("n"))


@query
def relation_filter(spark, sf_dir):
    found = graph.cooccurrences(_mentions(spark, sf_dir)).withColumn("predicate", F.lit("CO_OCCURS"))
    return graph.relations_like(found, "th", "occur", "AN", 40).select("subject", "predicate", "object", F.round("confidence", 6).alias("confidence"))


@query
def entity_detail(spark, sf_dir):
    return graph.detail(_mentions(spark, sf_dir), corpus(spark, sf_dir), "Enti").select("name", "document_id", "source_type", "source_path", _time("captured_at"))


@query
def relations_cooccur(spark, sf_dir):
    return graph.cooccurrences(settled(_mentions(spark, sf_dir))).select("subject", "object", "n_documents", F.round("confidence", 6).alias("confidence"))


@query
def graph_counts(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    return graph.counts(graph.rollup(rows), rows, corpus(spark, sf_dir), _chunks(spark, sf_dir))


# Retrieval


@query
def temporal_decay(spark, sf_dir):
    return corpus(spark, sf_dir).select("document_id", F.round(recall.decay(F.col("captured_at"), F.lit(AS_OF).cast("timestamp_ntz"), Settings().decay), 6).alias("score"))


@query
def hybrid_search(spark, sf_dir):
    return _result(_search(spark, sf_dir))


@query
def hybrid_search_filtered(spark, sf_dir):
    return _result(_search(spark, sf_dir, k=50, source_type="browser", after="2024-01-02", before="2024-02-01"))


@query
def hybrid_search_prefilter(spark, sf_dir):
    return _result(_search(spark, sf_dir, k=50, source_type="browser", after="2024-01-02", before="2024-02-01", prefilter=True))


@query
def search_projection(spark, sf_dir):
    return recall.projected(_search(spark, sf_dir))


@query
def timeline_status(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("status", F.when(F.col("document_id") % 11 == 0, "FAILED").otherwise("INDEXED"))
    return recall.timeline(docs, 300, 2, after="2024-01-02", status="FAILED").select("document_id", _time("captured_at"))


@query
def timeline_page(spark, sf_dir):
    return recall.timeline(corpus(spark, sf_dir), 25, 10, "browser", "2024-01-02", "2024-02-01").select("document_id", "source_type", "source_path", _time("captured_at"))


@query
def document_detail(spark, sf_dir):
    return recall.document_detail(corpus(spark, sf_dir), _chunks(spark, sf_dir), 7).select("document_id", "source_path", F.explode("chunks").alias("c")).select("document_id", "source_path", F.col("c.chunk_index").alias("chunk_index"), F.col("c.content").alias("content"))


# Answers


@query
def context_budget(spark, sf_dir):
    return answer.within_budget(_search(spark, sf_dir), 4000).select("query_id", "citation_index", "chunk_id", "context_tokens")


@query
def context_block(spark, sf_dir):
    return answer.context_block(answer.within_budget(_search(spark, sf_dir)))


@query
def history_last_n(spark, sf_dir):
    return answer.history(_turns(spark, sf_dir)).select("session_id", "turn", "role", "content")


@query
def history_block(spark, sf_dir):
    return answer.history_block(_turns(spark, sf_dir))


@query
def citation_extract(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" [Source "), (F.col("turn") % 5 + 1).cast("string"), F.lit("] and [Source 2][Source 2]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(answer.cited(text)).alias("source"))


@query
def citation_cards(spark, sf_dir):
    said = _asked(spark, sf_dir).select("query_id", F.lit("As said [Source 1], [Source 3] and [Source 99].").alias("answer"))
    return answer.citation_cards(_search(spark, sf_dir), said)


@query
def chat_answers(spark, sf_dir):
    context = answer.context_block(answer.within_budget(_search(spark, sf_dir))).join(_asked(spark, sf_dir).select("query_id", "query"), "query_id")
    return answer.answers(context.select("query_id", answer.prompt(F.col("query"), F.col("context")).alias("prompt"))).select("query_id", "answer")


@query
def chat_turns(spark, sf_dir):
    """A turn more in each session whose id is divisible by 20."""
    turns = _turns(spark, sf_dir)
    said = turns.filter("session_id % 20 = 0 and turn = 0").select("session_id", F.col("content").alias("query"), F.lit("Noted.").alias("answer"), F.lit("2025-01-01 00:00:00").alias("asked_at"))
    return answer.new_turns(turns, said).select("session_id", "turn", "role", "content", _time("created_at"))


@query
def session_delete(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return answer.without_sessions(turns, turns.filter("session_id % 20 = 0")).groupBy("session_id").agg(F.count("*").alias("n_turns"))


@query
def session_list(spark, sf_dir):
    return answer.sessions(_turns(spark, sf_dir)).select("session_id", _time("created_at"), _time("last_active"), "n_turns", "title")


# Mutations


def _memory(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    return {"documents": corpus(spark, sf_dir).select("document_id", "source_type"), "chunks": _chunks(spark, sf_dir).select("document_id", "chunk_id"), "mentions": rows.select("document_id", "name"), "entities": graph.rollup(rows)}


def _left(tables):
    return protect.verify_forgotten(tables, tables["documents"]).select("table_name", F.col("remaining").alias("n_rows"))


@query
def forget_document(spark, sf_dir):
    return _left(protect.forget(_memory(spark, sf_dir), spark.createDataFrame([(7,), (11,)], "document_id long")))


@query
def forget_by_source(spark, sf_dir):
    tables = _memory(spark, sf_dir)
    return _left(protect.forget(tables, tables["documents"].filter("source_type = 'browser'")))


@query
def forget_verify(spark, sf_dir):
    tables = _memory(spark, sf_dir)
    ids = tables["documents"].filter("source_type = 'browser'")
    return protect.verify_forgotten({**protect.forget(tables, ids), "kept_chunks": tables["chunks"]}, ids)


@query
def orphan_entities(spark, sf_dir):
    tables = _memory(spark, sf_dir)
    left = tables["mentions"].filter(F.col("document_id") % 4 != 1)
    return protect.orphans(tables["entities"], left).select("canonical_name")


@query
def purge_raw(spark, sf_dir):
    rows = protect.purge_raw(corpus(spark, sf_dir).withColumn("raw_content", F.col("text")), "2024-01-20 12:00:00")
    return rows.select("document_id", F.col("raw_content").isNull().alias("purged"), _time("raw_purged_at"))


@query
def retry_state(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("PARSED").alias("status"), (F.col("doc_id") % 6).cast("long").alias("retry_count"))
    return protect.failed(rows, rows.filter(F.col("document_id") % 3 == 0)).select("document_id", "status", "retry_count")


@query
def status_update(spark, sf_dir):
    """Each event changes the status of a document: the last one counts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("PENDING").alias("status"))
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.upper("event_type").alias("status"), F.struct("ts", "event_id").alias("changed_at"))
    return protect.with_status(docs, changes)


@query
def chunk_vectors(spark, sf_dir):
    return vector.linked(_chunks(spark, sf_dir), _vectors(spark, sf_dir), AS_OF).select("chunk_id", "vector_id", _time("embedded_at"))


@query
def expired_turns(spark, sf_dir):
    return protect.expired_turns(_turns(spark, sf_dir), "2025-01-03 00:00:00").select("session_id", "turn")


# Observation


@query
def stats_overview(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("status", F.when(F.col("document_id") % 11 == 0, "FAILED").otherwise("INDEXED"))
    rows = settled(_mentions(spark, sf_dir))
    out = observe.stats_overview(docs, _chunks(spark, sf_dir), _vectors(spark, sf_dir), graph.rollup(rows), _turns(spark, sf_dir), rows, graph.cooccurrences(rows))
    return out.withColumn("by_source", F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","))


@query
def health_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("store")).agg((F.max("value") < 400).alias("ok"))
    return observe.health(rows).select("healthy", F.array_join("failing", ",").alias("failing"))


@query
def throughput_check(spark, sf_dir):
    rows = observe.percentiles(_observations(spark, sf_dir))
    return rows.select("metric", observe.throughput_violated(F.col("p50") * 50).alias("violated"))


@query
def model_registry(spark, sf_dir):
    """The registry from a log: each event is a status that one of three versions of a model, named as its type, took."""
    status = F.element_at(F.array(*map(F.lit, ("RUNNING", "COMPLETE", "ACTIVE", "FAILED", "CANCELLED"))), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    version = F.pmod("user_id", F.lit(3)).cast("string")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.concat_ws("-", "event_type", version).alias("model_id"), F.col("event_type").alias("name"), version.alias("version"), F.concat(F.lit("vectors-"), "event_type").alias("path"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("noted_at"))
    return vector.registry(log)


@query
def migration_check(spark, sf_dir):
    return vector.validated(_chunks(spark, sf_dir), _vectors(spark, sf_dir))


@query
def file_admission(spark, sf_dir):
    """Paths of documents as files, with sizes and hidden folders from their ids."""
    prefix = F.element_at(F.array(*map(F.lit, ("home/", "home/.git/", ".cache/x/", "home/.config/", "a/node_modules/"))), (F.col("document_id") % 5 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, ("", ".swp", ".tmp", ".md"))), (F.col("document_id") % 4 + 1).cast("int"))
    size = F.when(F.col("document_id") % 7 == 0, F.lit(0)).when(F.col("document_id") % 9 == 0, F.lit(60 << 20)).otherwise(F.length("text"))
    path = F.concat(prefix, F.col("document_id").cast("string"), ending)
    return corpus(spark, sf_dir).select("document_id", files.admitted(path, size).alias("admitted"))


@query
def file_documents(spark, sf_dir):
    rows = corpus(spark, sf_dir).select(F.concat(F.lit("notes/"), "source_path").alias("path"), F.col("captured_at").alias("modificationTime"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return files.raw_documents(rows).select("checksum", "source_type", F.length("raw_bytes").alias("n_bytes"), F.col("source_metadata")["size"].alias("size"), "priority")


@query
def browser_visits(spark, sf_dir):
    """Visits after a cursor: two browsers, each with a cursor of its own."""
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", parse.html_title(F.col("html")).alias("title"))
    visits = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 300).alias("url"), F.col("ts").alias("visit_time"))
    chrome, firefox = (capture.new_visits(visits.filter(F.col("id") % 2 == k), urls, after).withColumn("browser", F.lit(name)) for k, after, name in ((0, 100, "chrome"), (1, 700, "firefox")))
    return chrome.unionByName(firefox).select("browser", "visit_id", "url", "title")


@query
def parse_dispatch(spark, sf_dir):
    """All content types through the dispatch."""
    rows = corpus(spark, sf_dir).select("document_id", "text", "source_path")
    return parse.parsed(rows).select("document_id", "content_type", F.md5("clean_content").alias("digest"), "word_count", "error_class")


@query
def count_by_source(spark, sf_dir):
    return observe.count_by_source(corpus(spark, sf_dir))


@query
def latency_percentiles(spark, sf_dir):
    return observe.percentiles(_observations(spark, sf_dir))


@query
def metric_gauges(spark, sf_dir):
    return observe.gauges(_observations(spark, sf_dir))


@query
def slo_report(spark, sf_dir):
    return observe.slo_report(spark, _observations(spark, sf_dir))


# Streams


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4()}"


def _stream(spark, sf_dir, name: str) -> DataFrame:
    """A table as a stream: the files of its folder, or the one file beside others."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _finished(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there into Parquet and read the result."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_ingest(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("arrival"), "text", F.sha2("text", 256).alias("checksum"), (F.col("doc_id") % 4).alias("priority"))
    folder = _folder(spark)
    ingest.ingest(docs, folder, f"{folder}/state").awaitTermination()
    return ingest.stored(spark, folder).select("arrival", "checksum", "priority")


@query
def stream_seen_state(spark, sf_dir):
    """As stream_ingest, the checksums seen being state of the query."""
    docs = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("arrival"), "text", F.sha2("text", 256).alias("checksum"), (F.col("doc_id") % 4).alias("priority"))
    folder = _folder(spark)
    ingest.ingest(docs, folder, f"{folder}/state", as_state=True).awaitTermination()
    return ingest.stored(spark, folder).select("arrival", "checksum", "priority")


@query
def stream_dedup(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.lit(AS_OF).cast("timestamp").alias("captured_at"))
    return _finished(ingest.deduplicated(docs), _folder(spark)).select("checksum")


@query
def stream_metrics(spark, sf_dir):
    return _finished(ingest.daily_metrics(_stream(spark, sf_dir, "events")), _folder(spark))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.statements().items() if k in _QUERIES}

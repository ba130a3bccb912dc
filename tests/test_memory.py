"""Fusion, forgetting, retention, percentiles, store and streams."""

from __future__ import annotations

import datetime as dt
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.config import Settings, load_settings
from palimpsest.engine import DocumentMemory
from palimpsest.functions.text import nearest_rank, terms
from palimpsest.operators import answer, graph, keyword, parse, protect, recall, vector
from palimpsest.operators.store import checkpoint_folder
from palimpsest.sources import capture
from palimpsest.sources import files as sources_files
from palimpsest.sources.history import HistorySource
from palimpsest.streaming import ingest
from tests.conftest import SMALL


def test_weights_and_limits():
    s = Settings()
    assert abs(s.vector_weight + s.keyword_weight + s.graph_weight + s.temporal_weight - 1) < 1e-12
    assert [s.limit(k) for k in (None, 0, 7, 80)] == [20, 20, 7, 50]
    assert load_settings(environ={"PALIMPSEST_DECAY": "0.1"}).decay == 0.1


def test_fusion_order(spark):
    rows = [("a", 0.9, 0.3, 0.0, 1.0), ("b", 0.5, 0.7, 0.0, 0.5), ("c", 0.1, 0.2, 0.8, 0.1)]
    signals = spark.createDataFrame([(1, r[0], s, r[i]) for r in rows for i, s in enumerate(("vector", "keyword", "graph", "temporal"), 1)], "query_id int, chunk_id string, signal string, score double")
    got = {r.chunk_id: round(r.combined_score, 6) for r in recall.fuse(signals, Settings()).collect()}
    assert got == {"a": 0.55, "b": 0.46, "c": 0.27}


def test_decay(spark):
    age = lambda d: F.lit(dt.datetime(2025, 1, 1) - dt.timedelta(days=d)).cast("timestamp_ntz")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(*(F.round(recall.decay(age(d), now, 0.005), 6) for d in (7, 365)), recall.decay(F.lit(None).cast("timestamp_ntz"), now, 0.005)).first()
    assert list(row) == [0.965605, 0.161218, 0.5]


def test_percentile_rule(spark):
    row = spark.range(1).select(*(nearest_rank(F.array(*(F.lit(float(i)) for i in range(10, 0, -1))), p) for p in (50, 95, 99)), nearest_rank(F.array().cast("array<double>"), 50)).first()
    assert list(row) == [6.0, 10.0, 10.0, 0.0]


def test_excluded_hosts(spark):
    hosts = ["chase.com", "www.okta.com", "mychart.x.org", "notepic.com", "localhost", "github.com", "docs.python.org", None]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(capture.is_excluded(F.col("h"))).collect()
    assert [r[0] for r in rows] == [True, True, True, True, True, False, False, False]


def test_arrival_and_retry(spark):
    rows = spark.createDataFrame([(None, 0), ("INDEXED", 0), ("FAILED", 4), ("FAILED", 5), ("PENDING", 0)], "s string, r int").select(protect.arrival_decision(F.col("s"), F.col("r"))).collect()
    assert [r[0] for r in rows] == ["NEW", "SKIP", "RERUN_CLEAN", "SKIP", "RERUN"]


def _vectors(spark, n=3000, dims=64):
    x = np.random.default_rng(1).standard_normal((n, dims))
    rows = [(str(i), v.tolist()) for i, v in enumerate(x)] + [("none", None), ("zero", [0.0] * dims), ("short", [1.0])]
    return x, spark.createDataFrame(rows, "id string, embedding array<double>")


def test_nearest_like_brute_force(spark, monkeypatch):
    """Several blocks of vectors and of queries; vectors that are null, zero or short have similarity 0."""
    monkeypatch.setattr(vector, "BLOCK_ROWS", 700)
    monkeypatch.setattr(vector, "QUERY_ROWS", 40)
    x, vectors = _vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 20)], "query_id long, query_vector array<double>")
    got = {(r.query_id, r.place): (r.id, r.similarity) for r in vector.nearest(vectors, asked, 10).collect()}
    for i in range(0, 3000, 20):
        s = np.maximum(np.round(unit @ unit[i], 9), 0)
        best = sorted(range(3000), key=lambda j: (-s[j], str(j)))[:10]
        assert [got[i, k + 1][0] for k in range(10)] == [str(j) for j in best]
        assert np.allclose([got[i, k + 1][1] for k in range(10)], s[best], atol=1e-9)
    assert vector.nearest(vectors, asked.limit(1), 5000).count() == 3003
    assert vector.nearest(vectors.limit(0), asked).count() == vector.nearest(vectors, asked.limit(0)).count() == 0


def test_sketches_reach_their_recall(spark):
    """Recall at 10 against the exact search, for all queries of the tables and for vectors without any clusters."""
    from palimpsest.plans import catalog

    own = vector.lsh_nearest(catalog._vectors(spark, SMALL), catalog._asked_vectors(spark, SMALL), 10)
    exact = vector.nearest(catalog._vectors(spark, SMALL), catalog._asked_vectors(spark, SMALL), 10)
    x, vectors = _vectors(spark)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 20)], "query_id long, query_vector array<double>")
    for found, want in ((own, exact), (vector.lsh_nearest(vectors, asked, 10), vector.nearest(vectors, asked, 10))):
        a, b = ({(r.query_id, r.id) for r in df.collect()} for df in (found, want))
        assert len(a & b) / len(b) >= 0.9
    assert {(r.query_id, r.id) for r in vector.lsh_nearest(vectors, asked, 10, share=1.0).collect()} == b


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_like_brute_force(spark, stem):
    """Words and phrases over the smallest corpus, with and without stemming, on chunks and on a stored index."""
    from palimpsest.functions.stem import stem as stem_of
    from palimpsest.plans import catalog

    chunks = catalog._chunks(spark, SMALL)
    texts = [(1, "heonha, thin-the of NOT (and)"), (2, "entions thinly thndly"), (3, "?!"), (4, "zzz the the")]
    queries = spark.createDataFrame(texts, "query_id long, query string")
    form = stem_of if stem else (lambda t: t)
    lists = {r.chunk_id: [form(t) for t in keyword.terms_of(r.content)] for r in chunks.collect()}
    mean = sum(map(len, lists.values())) / len(lists)
    want = {}
    for q, words in ((1, [["heonha"], ["thin", "the"], ["of"], ["and"]]), (2, [["entions"], ["thinly"], ["thndly"]]), (4, [["zzz"], ["the"], ["the"]])):
        words = [list(map(form, w)) for w in words]
        words = [w for w in words if w != [form("and")]] if q == 1 else words  # an operator
        score = {}
        for w in words:
            tf = {c: sum(own[i : i + len(w)] == w for i in range(len(own))) for c, own in lists.items()}
            n = sum(v > 0 for v in tf.values())
            raw = math.log((len(lists) - n + 0.5) / (n + 0.5))
            for c, v in tf.items():
                if v:
                    score[c] = score.get(c, 0) - (raw if raw > 0 else 1e-6) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(lists[c]) / mean))
        want |= {(q, c): round(s, 5) for s, c in sorted((round(s, 9), c) for c, s in score.items())[:20]}
    for index in (keyword.postings(chunks, stem), None):
        found = keyword.bm25(chunks, queries, 20, stem=stem) if index is None else keyword.ranked(index, queries, 20, stem=stem)
        got = {(r.query_id, r.chunk_id): round(r["rank"], 5) for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_terms_in_python_and_in_spark(spark):
    texts = ["Éa b_c d-e ²x 日本 \ue000z \U0010fffdq ñÇ ß ǅ ١٢ a\u0301b", "", "  ", None, "IStanbul Σας"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", terms(F.col("t")).alias("own")).collect()
    assert all((r.own or []) == keyword.terms_of(r.t) for r in rows)


def test_prefiltered_scores_are_those_of_all_chunks(spark):
    from palimpsest.plans import catalog

    chunks, queries = catalog._chunks(spark, SMALL), catalog._asked(spark, SMALL)
    every = {(r.query_id, r.chunk_id): r["rank"] for r in keyword.bm25(chunks, queries, 10**6).collect()}
    some = keyword.bm25(chunks, queries, 20, allowed=chunks.filter("document_id % 4 = 1")).collect()
    assert some and all(every[r.query_id, r.chunk_id] == r["rank"] for r in some)


def test_embedding(spark):
    texts = ["the cat the", "", None, "Cat Dog"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, content string")
    for r in vector.embedded(rows, "hashing", "1").collect():
        v = np.zeros(64)
        for w in (r.content or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 31 else -1
        assert np.allclose(r.embedding, v / (np.linalg.norm(v) or 1), atol=1e-6) and (r.embed_model, r.embed_model_version) == ("hashing", "1")
    calls = []

    def failing(t):
        calls.append(1)
        raise OSError("no model")

    assert all(r.embedding is None for r in vector.embedded(rows, "m", "1", failing).collect())


def test_markdown_and_mail(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f("t")).first()[0]
    assert one(parse.markdown_text, "# A **b**\ntext [x](http://y)\n- item\n```\n# code\n```") == "A b\ntext x\nitem\n```\n# code\n```"
    assert one(parse.email_text, "Subject: s\nFrom: a@b.c\n\né ß 日本 text") == "Subject: s\nFrom: a@b.c\n\né ß 日本 text"
    assert one(parse.email_text, "Subject: s\nContent-Transfer-Encoding: base64\nContent-Type: text/plain; charset=utf-8\n\nw6k=") == "Subject: s\n\né"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Title\n=====\ntext\n\nPart\n---\nmore", "Title\ntext\n\nPart\nmore"),
        ("see [the page][p] and ![a picture](x.png)\n\n[p]: http://example.org \"t\"\n", "see the page and a picture"),
        ("| a | **b** |\n|:--|---|\n| 1 | [2](x) |\n\nend | of it", "a | b\n1 | 2\nend | of it"),
        ("````\n```\n# inner\n```\n````\n# After", "````\n```\n# inner\n```\n````\n\nAfter"),
        ("~~~ py\nx = *y*\n```\n~~~\n> said *so*\n1. one", "~~~ py\nx = *y*\n```\n~~~\nsaid so\none"),
        ("- item\n---\nrest", "item\n---\nrest"),
        ("", ""),
        ("```\nnever closed", "```\nnever closed"),
    ],
)
def test_blocks_of_markdown(text, want):
    assert parse._markdown(text) == want


def test_dispatch_parses_each_kind(spark):
    from palimpsest.plans import catalog

    rows = catalog.parse_dispatch(spark, SMALL).collect()
    assert {r.content_type for r in rows} >= {"plain", "markdown", "html", "email", "pdf", "code"} and len(rows) == 200
    assert all((r.digest is None) == (r.error_class == "EMPTY") for r in rows)


def test_code_finders_are_pluggable(spark):
    @F.pandas_udf("array<string>")
    def last_words(t: pd.Series, lang: pd.Series) -> pd.Series:
        return t.map(lambda x: x.split()[-1:])

    rows = spark.createDataFrame([("a/b.py", "def f(): pass end")], "source_path string, text string")
    assert "## Symbols\nend" in parse.parsed(rows, symbols_of=last_words).first().clean_content


def test_answers_quote_the_first_source(spark):
    prompts = spark.createDataFrame([(1, "x\n[Source 1] (captured: a, from: b)\nfirst text\nmore"), (2, "nothing")], "query_id long, prompt string")
    assert {r.query_id: r.answer for r in answer.answers(prompts).collect()} == {1: "first text [Source 1]", 2: answer.NO_CONTEXT}

    def broken(p):
        raise ValueError("down")

    assert all("down" in r.answer for r in answer.answers(prompts, broken).collect())


def test_citations(spark):
    assert spark.range(1).select(answer.cited(F.lit("a [Source 1] b [Source 2] [Source 1]"))).first()[0] == [1, 2]


def raw(spark, n=6):
    rows = [(i, f"Alpha Beta text number {i % 5}. Gamma said token= {i}", "browser" if i % 2 else "terminal", f"p/{i}.txt", dt.datetime(2024, 1, 1 + i), f"c{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "document_id long, text string, source_type string, source_path string, captured_at timestamp_ntz, checksum string")


def counted(memory):
    return {name: df.count() for name, df in memory.store.tables().items()}


def test_memory_end_to_end(spark, tmp_path):
    memory = DocumentMemory(spark, f"file://{tmp_path}/store", parts=4)
    assert memory.add(raw(spark)).count() == 5 and memory.add(raw(spark, 3)).count() == 0
    before = counted(memory)
    assert before["documents"] == 5 and memory.vectors().count() == before["chunks"] == memory.index.lengths().count() == memory.index.totals()[0]
    queries = spark.createDataFrame([(1, "Gamma number")], "query_id long, query string")
    found = memory.search(queries, "2025-01-01").orderBy("citation_index").collect()
    assert [r.citation_index for r in found] == list(range(1, 6)) and all(r.graph_score == 0.8 and r.vector_score > 0 and r.keyword_score >= 0 for r in found)
    plain = recall.hybrid_search(memory.store.read("documents"), memory.store.read("chunks"), queries, "2025-01-01", memory.store.read("mentions"))
    assert {r.chunk_id: r.keyword_score for r in plain.collect()} == {r.chunk_id: r.keyword_score for r in found}
    assert "[Source 1]" in memory.context(queries, "2025-01-01").first().context
    stats = memory.stats().first()
    assert (stats.documents, stats.embedding_coverage_pct, stats.graph_coverage_pct) == (5, 100.0, 100.0) and sum(stats.by_source.values()) == 5
    assert memory.relations(subject="alph").count() > 0 and memory.relations(predicate="nothing").count() == 0
    nodes, edges = memory.graph()
    assert {r.kind for r in nodes.collect()} == {"Document", "Chunk", "Entity"} and {r.kind for r in edges.collect()} == {"MENTIONED_IN", "CONTAINS", "RELATED_TO"}
    assert memory.entities().count() > 0
    one = memory.document_of("c2").first()
    assert one.document_id == 2 and memory.document_of("none").count() == 0 and memory.active_model().count() == 0
    assert memory.chunk(memory.store.read("chunks").filter("document_id = 2").first().chunk_id).first().source_path == one.source_path


def test_forgetting_reaches_index_and_vectors(spark, tmp_path):
    memory = DocumentMemory(spark, f"file://{tmp_path}/store", parts=4)
    memory.add(raw(spark))
    assert all(r.verified for r in memory.forget_source("browser", "2025-01-01").collect())
    assert {r.source_type for r in memory.timeline().collect()} == {"terminal"}
    left = {r.document_id for r in memory.store.read("documents").collect()}
    assert all({r.document_id for r in memory.store.read(name).select("document_id").collect()} <= left for name in memory.OF_DOCUMENTS)
    assert {r.document_id for r in memory.index.lengths().collect()} <= left and {r.document_id for r in memory.vectors().collect()} <= left
    assert memory.index.totals()[0] == memory.store.read("chunks").count() and memory.store.read("forget_log").count() == 5 - len(left)
    assert all(r.verified for r in memory.forget(memory.store.read("documents"), "2025-01-01").collect()) and set(counted(memory)[n] for n in memory.OF_DOCUMENTS) == {0} and memory.index.totals() == (0, 0) and memory.entities().count() == 0
    assert memory.add(raw(spark)).count() == 5


def test_a_failed_batch_is_added_again(spark, tmp_path, monkeypatch):
    memory = DocumentMemory(spark, f"file://{tmp_path}/store", parts=4)
    memory.add(raw(spark, 2))
    append = memory.store.append

    def until_documents(name, rows):
        if name == "documents":
            raise OSError("lost")
        append(name, rows)

    monkeypatch.setattr(memory.store, "append", until_documents)
    with pytest.raises(OSError, match="lost"):
        memory.add(raw(spark))
    assert memory.store.read("documents").count() == 2 and memory.store.read("chunks").count() == 5
    monkeypatch.undo()
    memory.add(raw(spark))
    assert memory.store.read("documents").count() == 5 and memory.store.read("chunks").select("chunk_id").distinct().count() == memory.store.read("chunks").count() == 5


def test_chat_keeps_turns(spark, tmp_path):
    memory = DocumentMemory(spark, f"file://{tmp_path}/store", parts=4)
    memory.add(raw(spark))
    asked = lambda q, at: spark.createDataFrame([(1, 7, q, at)], "query_id long, session_id long, query string, asked_at string")
    first = memory.chat(asked("Gamma number", "2025-01-01 10:00:00"), "2025-01-01").first()
    assert first.answer.endswith("[Source 1]") and [c.citation_index for c in first.citations] == [1]
    prompts = []
    memory.chat(asked("And Alpha?", "2025-01-01 11:00:00"), "2025-01-01", lambda p: p.map(lambda x: f"seen {'USER: Gamma number' in x}"))
    assert [(r.turn, r.role, r.content) for r in memory.history(7).collect()][2:] == [(3, "user", "And Alpha?"), (4, "assistant", "seen True")]
    assert [(r.title, r.n_turns) for r in memory.sessions().collect()] == [("Gamma number", 4)] and not prompts
    memory.chat(spark.createDataFrame([(1, 8, "Beta", "2020-01-01 00:00:00")], "query_id long, session_id long, query string, asked_at string"), "2025-01-01")
    assert {r.session_id for r in memory.purge_turns("2025-02-01").collect()} == {8}
    memory.delete_sessions(spark.createDataFrame([(7,)], "session_id long"))
    assert memory.store.read("turns").count() == 0


def test_migration(spark, tmp_path):
    memory = DocumentMemory(spark, f"file://{tmp_path}/store", parts=4)
    memory.add(raw(spark))

    def broken(t):
        raise OSError("no model")

    assert memory.migrate("bad", "1", "2025-01-01", broken).first().status == "FAILED"
    assert {r.embed_model for r in memory.vectors().collect()} == {"hashing"} and not any(r.is_active for r in memory.models().collect())
    assert memory.migrate("wide", "2", "2025-01-02", vector.hashing_embedder(128)).first().status == "COMPLETE"
    assert {len(r.embedding) for r in memory.vectors().collect()} == {128} and {r.model_id for r in memory.models().filter("is_active").collect()} == {"wide-2"}
    assert memory.search(spark.createDataFrame([(1, "Gamma")], "query_id long, query string"), "2025-01-01").count() == 5


def test_a_reopened_memory_takes_the_active_model(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    memory = DocumentMemory(spark, path, parts=4)
    memory.add(raw(spark, 4))
    assert memory.migrate("other", "2", "2025-01-02", vector.hashing_embedder(32)).first().status == "COMPLETE"
    again, queries = DocumentMemory(spark, path, parts=4, embed=vector.hashing_embedder(32)), spark.createDataFrame([(1, "Gamma number")], "query_id long, query string")
    assert again.model == ("other", "2") and all(r.vector_score > 0 for r in again.search(queries, "2025-01-01").collect())
    with pytest.raises(ValueError, match="open the memory with its function"):
        DocumentMemory(spark, path, parts=4).search(queries, "2025-01-01")
    with pytest.raises(ValueError, match="length 32"):
        DocumentMemory(spark, path, parts=4).search(queries.withColumn("query_vector", F.array(*map(F.lit, [0.5] * 64))), "2025-01-01")
    again.add(raw(spark))
    assert again.vectors().count() == again.store.read("chunks").count() == 5 and {len(r.embedding) for r in again.vectors().collect()} == {32}


def test_a_migration_is_cancelled_and_resumed(spark, tmp_path):
    memory = DocumentMemory(spark, f"file://{tmp_path}/store", parts=8)
    memory.add(raw(spark))
    embed, total = vector.hashing_embedder(16), memory.store.read("chunks").count()
    append, steps = memory.store.append, []

    def killed(name, rows):
        if name.startswith("vectors-new"):
            steps.append(rows.count())
            if sum(steps) > 2:
                raise OSError("killed")
        append(name, rows)

    memory.store.append = killed
    with pytest.raises(OSError, match="killed"):
        memory.migrate("new", "1", "2025-01-02", embed)
    memory.store.append = append
    done = memory.migration("new", "1").first()
    assert 0 < done.migrated_chunks < total and done.status == "IN_PROGRESS" and memory.model == ("hashing", "1")

    def cancelling(name, rows):
        append(name, rows)
        if name.startswith("vectors-new"):
            memory.cancel_migration("new", "1", "2025-01-02")

    memory.store.append = cancelling
    assert memory.migrate("new", "1", "2025-01-02", embed).first().status == "CANCELLED"
    memory.store.append = append
    assert memory.model == ("hashing", "1") and DocumentMemory(spark, memory.store.path, parts=8).model == ("hashing", "1")
    made = []
    memory.store.append = lambda name, rows: (made.append(rows.count()) if name.startswith("vectors-new") else None, append(name, rows))
    assert memory.migrate("new", "1", "2025-01-03", embed).first().status == "COMPLETE"
    assert sum(made) < total and memory.vectors().select("id").distinct().count() == memory.vectors().count() == total
    assert {(r.model_id, r.status, r.is_active) for r in memory.models().collect()} == {("new-1", "ACTIVE", True)}


def test_counts_by_difference_equal_a_roll_up(spark, tmp_path):
    memory = DocumentMemory(spark, f"file://{tmp_path}/store", parts=4)
    rows = lambda df: sorted(map(tuple, df.collect()))
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], memory.store.read("documents").select("document_id").schema)
    all_ids = [r.document_id for r in raw(spark, 12).select("document_id").collect()]
    for change in (lambda: memory.add(raw(spark, 5)), lambda: memory.add(raw(spark, 12)), lambda: memory.forget(ids(*all_ids[:2]), "2025-01-01"), lambda: memory.add(raw(spark, 3)), lambda: memory.reindex(ids(all_ids[4])), lambda: memory.forget(ids(all_ids[0], all_ids[-1]), "2025-01-01"), memory.compact, lambda: memory.forget(ids(all_ids[6]), "2025-01-01")):
        change()
        mentions = memory.store.read("mentions")
        names = ["canonical_name", "entity_type", "first_seen", "last_seen", "mention_count"]
        assert rows(memory._names().select(*names)) == rows(graph.rollup(mentions).select(*names))
        pair = ["subject", "object", "n_documents", "confidence"]
        assert rows(memory._relations().select(*pair)) == rows(graph.cooccurrences(mentions, memory.settings.relation_confidence).select(*pair))
        assert memory.index.totals()[0] == memory.store.read("chunks").count()


def test_parts_written_beside_are_put_in_place_at_the_next_opening(spark, tmp_path, monkeypatch):
    from palimpsest.operators.store import TableFolder

    folder = TableFolder(spark, f"file://{tmp_path}/t", {"x": "k"}, 4)
    folder.append("x", spark.range(100).withColumnRenamed("id", "k"))
    monkeypatch.setattr(TableFolder, "_finish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        folder.delete("x", "k", spark.range(50).withColumnRenamed("id", "k"))
    monkeypatch.undo()
    assert folder.read("x").count() == 100
    assert sorted(r.k for r in TableFolder(spark, f"file://{tmp_path}/t", {"x": "k"}, 4).read("x").collect()) == list(range(50, 100))


def test_extractors_are_pluggable(spark):
    @F.pandas_udf("array<struct<name: string, label: string>>")
    def people(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{"name": " Ann ", "label": "PERSON"}, {"name": "Oslo", "label": "GPE"}, {"name": "Oslo", "label": "GPE"}, {"name": "x", "label": "?"}])

    found = graph.rollup(graph.mentions(raw(spark, 2), "text", people)).collect()
    assert {(r.canonical_name, r.entity_type, r.mention_count) for r in found} == {("Ann", "PERSON", 2), ("Oslo", "PLACE", 2), ("x", "CONCEPT", 2)}


def test_graph_merges(spark):
    node = lambda rows: spark.createDataFrame(rows, "kind string, id string, note string")
    assert {(r.id, r.note) for r in graph.merged_nodes(node([("E", "a", "old")]), node([("E", "a", "new"), ("E", "b", "new")])).collect()} == {("a", "old"), ("b", "new")}
    edge = lambda rows: spark.createDataFrame(rows, "kind string, src string, dst string, confidence double")
    assert graph.merged_edges(edge([("R", "a", "b", 1.0)]), edge([("R", "a", "b", 1.0), ("R", "a", "b", 0.5)])).count() == 2


@pytest.mark.parametrize("capacity", [None, 4])
def test_stream_ingest_keeps_each_content_once(spark, tmp_path, capacity):
    source, ddl = f"{tmp_path}/in", "arrival long, text string, checksum string, priority int"
    for k in range(2):
        rows = [(10 * k + i, f"t{i}", f"c{i}", i % 4) for i in range(5)] + [(10 * k + 5, None, "c9", 0), (10 * k + 6, "bad", f"b{k}", 0), (10 * k + 7, "t1", "c1", 1)]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    bad = lambda t: F.when(t == "bad", F.lit("parse failed"))
    ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", capacity=capacity, check=bad).awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out/documents")
    assert kept.count() == kept.select("checksum").distinct().count() == (5 if capacity is None else 4)
    if capacity:
        assert spark.read.parquet(f"{tmp_path}/out/dropped").count() == 8
    else:
        assert sorted(r.error for r in spark.read.parquet(f"{tmp_path}/out/dead_letters").collect()) == ["no content"] * 2 + ["parse failed"] * 2


def test_checksums_seen_are_state_of_the_stream(spark, tmp_path):
    """A restart goes on with them, and no batch looks at what is stored: it may even be gone."""
    source, ddl = f"{tmp_path}/in", "arrival long, text string, checksum string, priority int"

    def run(rows, out, **options):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.ingest(stream, f"{tmp_path}/{out}", f"{tmp_path}/state", as_state=True, **options).awaitTermination()
        return [sorted(r.arrival for r in spark.read.parquet(f"{tmp_path}/{out}/{name}").collect()) for name in ("documents", "dead_letters")]

    assert run([(3, "t1", "c1", 0), (1, "t1", "c1", 0), (2, "t2", "c2", 1), (4, None, "c3", 1), (5, None, None, 1)], "one") == [[1, 2], [4, 5]]
    assert run([(6, "t1", "c1", 0), (7, "t3", "c3", 0), (8, None, "c3", 0), (9, "t3", "c3", 0)], "two") == [[7], [8]]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ingest.ROCKSDB
    with pytest.raises(ValueError, match="capacity"):
        ingest.ingest(spark.readStream.schema(ddl).parquet(source), f"{tmp_path}/no", f"{tmp_path}/no-state", capacity=5, as_state=True)


@pytest.mark.parametrize("as_state", [False, True])
def test_the_least_arrival_is_kept_in_any_order_of_files(spark, tmp_path, as_state):
    source, ddl = f"{tmp_path}/in", "arrival long, text string, checksum string, priority int"
    for rows in ([(30, "t1", "c1", 2), (31, "t2", "c2", 3)], [(10, "t1", "c1", 2), (11, "t3", "c3", 3), (12, "t1", "c1", 0)], [(20, "t1", "c1", 0), (21, "t2", "c2", 1)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", as_state=as_state).awaitTermination()
    assert sorted(map(tuple, ingest.stored(spark, f"{tmp_path}/out").select("arrival", "checksum", "priority").collect())) == [(10, "c1", 2), (11, "c3", 3), (21, "c2", 1)]


def test_state_outlives_a_batch_of_the_same_run(spark, tmp_path):
    source, ddl = f"{tmp_path}/in", "arrival long, text string, checksum string, priority int"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, f"t{i}", f"c{i}", 0) for i in range(3)], ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", as_state=True).awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/out/documents")
    assert sorted(r.arrival for r in stored.collect()) == [0, 1, 2] and stored.agg(F.max("batch")).first()[0] == 0


def test_checksums_are_forgotten_after_their_time(spark, tmp_path):
    import time

    source, ddl, out = f"{tmp_path}/in", "arrival long, checksum string, error string", f"{tmp_path}/out"
    add = lambda k: spark.createDataFrame([(k, "c1", None)], ddl).coalesce(1).write.mode("append").parquet(source)
    seen = lambda: sorted(r.arrival for r in spark.read.schema(ddl).parquet(out).collect()) if (tmp_path / "out").exists() else []
    add(0)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKSDB)
    rows = ingest.first_seen(spark.readStream.schema(ddl).parquet(source), dt.timedelta(seconds=3))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    try:
        for k, want in ((1, [0]), (2, [0, 2])):
            until = time.time() + 30
            while seen() != want and time.time() < until:
                time.sleep(0.5)
            assert seen() == want
            if k == 1:
                time.sleep(4)
                add(2)
    finally:
        query.stop()
    with pytest.raises(ValueError, match="available_now"):
        ingest.ingest(spark.readStream.schema(ddl).parquet(source), out, f"{tmp_path}/no", as_state=True, forget_after=dt.timedelta(seconds=1))


def test_repeats_are_left_out_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("s", i, c) for i, c in enumerate("aabba")], "k string, i int, c string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, i int, c string").parquet(f"{tmp_path}/in")
    query = ingest.without_repeats(stream, "k", "i", "c").writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.i for r in spark.table("kept").orderBy("i").collect()] == [0, 2, 4]


def test_history_source(spark, tmp_path):
    path = tmp_path / ".zsh_history"
    path.write_text(": 1700000000:0;git status\n\nls\n\n: 1700000001:0;make all\n")
    spark.dataSource.register(HistorySource)
    rows = spark.read.format("shell_history").option("paths", str(path)).load().withColumn("captured_at", F.lit(0))
    assert sorted(r.content for r in capture.terminal_documents(rows).collect()) == ["git status", "make all"]


def test_history_stream_ends_at_whole_lines(spark, tmp_path):
    path = tmp_path / "history"
    path.write_text("first é\nsecond\nthi")
    spark.dataSource.register(HistorySource)

    def run():
        stream = spark.readStream.format("shell_history").option("paths", str(path)).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.history for r in spark.read.schema("path string, history string").parquet(f"{tmp_path}/out").collect())

    assert run() == ["first é\nsecond\n"]
    path.write_text("first é\nsecond\nthird\n")
    assert run() == ["first é\nsecond\n", "third\n"]


def test_files_are_scanned(spark, tmp_path):
    for name, content in (("a.txt", b"one"), ("b.txt", b"one"), ("c.swp", b"x"), (".git/d", b"y"), ("sub/e", b"zz"), ("empty", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = sources_files.read_files(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.raw_bytes) for r in got) == [b"one", b"zz"] and {r.source_metadata["size"] for r in got} == {"3", "2"}


def test_shared_folder_is_required_off_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_folder(Session)

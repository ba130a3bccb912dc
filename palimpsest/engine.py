"""The document memory as one object over plain Parquet folders: each method returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import Settings
from palimpsest.operators import answer, chunk, graph, observe, parse, protect, recall, redact, vector
from palimpsest.operators.index import KeywordIndex
from palimpsest.operators.store import TableFolder, settled

Embedder = Callable[[pd.Series], pd.Series]


class DocumentMemory:
    """Documents with their chunks, keyword index, vectors of each model, mentions and counts of names; conversations; the log of models and of what was forgotten.

    An addition appends to every table and reads none but the checksums of `documents`, which is written last. What it is about to
    write is noted in `pending`: a batch whose run failed is not known, and its rows are cleared before the next addition. A
    deletion rewrites the parts of chunks and vectors that hold its documents; the index and the counts get rows that take them off.
    """

    KEYS = {"documents": "document_id", "chunks": "document_id", "mentions": "document_id", "turns": "session_id", "forget_log": "document_id", "pending": "document_id", "models": "model_id", "name_deltas": "name", "pair_deltas": "low"}
    OF_DOCUMENTS = ("mentions", "chunks", "documents")

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), model: tuple[str, str] = ("hashing", "1"), embed: Embedder | None = None, extract: Callable[[Column], Column] | None = None, parts: int = 32) -> None:
        """model: the one that vectors are made with as long as no migration made another active; embed: its function (of the active model)."""
        self.spark, self.settings, self.embed, self.extract = spark, settings, embed, extract
        self.store, self.index = TableFolder(spark, path, self.KEYS, parts), KeywordIndex(spark, f"{path.rstrip('/')}/index", parts)
        active = self.models().filter("is_active").first()
        self.model = (active["name"], active["version"]) if active else model
        self._made = active is None or self.model == model or embed is not None

    # Documents

    def add(self, raw: DataFrame) -> DataFrame:
        """Ingest raw rows (document_id, text, source_type, source_path, captured_at, checksum): parse, redact, chunk, index, embed, extract.

        Returns the documents added: those whose checksum is new. A text that cannot be parsed is kept as FAILED without chunks.
        """
        if self.store.has("pending"):
            self._clear(self.store.read("pending").join(self.store.read("documents"), "document_id", "left_anti") if self.store.has("documents") else self.store.read("pending"))
            self.store.drop("pending")
        new = protect.first_of_checksum(raw, "document_id", self.store.read("documents") if self.store.has("documents") else None)
        done = parse.parsed(new).withColumn("clean_content", redact.redact(F.col("clean_content")))
        failed = F.col("error_class").isNotNull()
        docs = settled(done.select("document_id", "source_type", "source_path", "captured_at", "checksum", "content_type", "clean_content", "word_count", F.when(failed, "FAILED").otherwise("INDEXED").alias("status"), F.when(failed, 1).otherwise(0).alias("retry_count")))
        self.store.append("pending", docs.select("document_id"))
        self._index(docs)
        self.store.append("documents", docs)
        self.store.drop("pending")
        return docs

    def _index(self, docs: DataFrame) -> None:
        """Chunks, keyword index, vectors, mentions and counts of docs that have none."""
        number = self.index.next_number()
        pieces = settled(chunk.chunks(docs.filter("status <> 'FAILED'"), "clean_content", "content_type"))
        self.store.append("chunks", pieces.withColumn("segment", F.lit(number).cast("long")))
        self.index.append(pieces, number)
        self.store.append(self._folder(*self.model), self._embedded(pieces, *self.model, self._embedder()))
        found = settled(graph.mentions(docs, "clean_content", self.extract))
        self.store.append("mentions", found)
        self._count(graph.name_deltas(found), graph.pair_deltas(found))

    def _count(self, names: DataFrame, pairs: DataFrame) -> None:
        at = F.lit(self._last("name_deltas") + 1).cast("long")
        self.store.append("pair_deltas", pairs)
        self.store.append("name_deltas", names.withColumn("at", at))

    def _last(self, name: str) -> int:
        return (self.store.read(name).agg(F.max("at")).first()[0] or 0) if self.store.has(name) else 0

    def _clear(self, ids: DataFrame) -> None:
        """Take the documents out of everything but `documents`. May be repeated."""
        keys = settled(ids.select("document_id").distinct())
        own = settled(self.store.read("chunks").join(keys, "document_id", "left_semi")) if self.store.has("chunks") else None
        if own is not None and own.limit(1).count():
            self.index.forget(own)
        if self.store.has("mentions"):
            gone = settled(self.store.read("mentions").join(keys, "document_id", "left_semi"))
            if gone.limit(1).count() and self.store.has("name_deltas"):
                less = graph.name_deltas(gone, -1)
                left = self.store.read("mentions").join(keys, "document_id", "left_anti")
                self._count(settled(less.unionByName(graph.resets(self._names(), less, left))), graph.pair_deltas(gone, -1))
        for name in (*self._folders(), *self.OF_DOCUMENTS[:-1]):
            self.store.delete(name, "document_id", keys)

    @staticmethod
    def _embedded(pieces: DataFrame, model: str, version: str, embed: Embedder | None) -> DataFrame:
        return vector.embedded(pieces, model, version, embed).select(F.col("chunk_id").alias("id"), "document_id", "embedding", "embed_model", "embed_model_version")

    def reindex(self, ids: DataFrame) -> None:
        """Chunk, index, embed and extract the given documents again."""
        docs = settled(self.store.read("documents").join(ids.select("document_id").distinct(), "document_id", "left_semi"))
        self._clear(docs)
        self._index(docs)

    def compact(self) -> None:
        """One segment of the index without what was deleted, and one count per name and pair. Searches and results stay as they are."""
        self.index.compact()
        if self.store.has("name_deltas"):
            names = self._names().select(F.col("canonical_name").alias("name"), "entity_type", F.col("mention_count").alias("n"), "first_seen", "last_seen", F.lit(False).alias("reset"), F.lit(1).cast("long").alias("at"))
            self.store.replace("name_deltas", names)
            self.store.replace("pair_deltas", self.store.read("pair_deltas").groupBy("low", "high").agg(F.sum("n").alias("n")).filter("n <> 0"))

    def document(self, document_id) -> DataFrame:
        return recall.document_detail(self.store.read("documents"), self.store.read("chunks"), document_id)

    def document_of(self, checksum: str) -> DataFrame:
        """The document with this checksum."""
        return self.store.read("documents").filter(F.col("checksum") == checksum)

    def chunk(self, chunk_id: str) -> DataFrame:
        """One chunk with the source of its document."""
        return self.store.read("chunks").filter(F.col("chunk_id") == chunk_id).drop("segment").join(self.store.read("documents").select("document_id", "source_type", "source_path", "captured_at"), "document_id", "left")

    def active_model(self) -> DataFrame:
        """The registry's row of the active model; no row as long as no migration made one active."""
        return self.models().filter("is_active")

    def timeline(self, **options) -> DataFrame:
        return recall.timeline(self.store.read("documents"), **options)

    def stats(self) -> DataFrame:
        t = self.store.tables()
        turns = t.get("turns", self.spark.createDataFrame([], answer.TURNS_DDL))
        return observe.stats_overview(t["documents"], t["chunks"], self.vectors().filter("embedding is not null"), self._names(), turns, t["mentions"], self._relations())

    def slo_report(self, observations: DataFrame) -> DataFrame:
        return observe.slo_report(self.spark, observations)

    # Search

    def search(self, queries: DataFrame, as_of: str, k: int | None = None, **filters) -> DataFrame:
        """Hybrid search of (query_id, query and, if the embedder is not to make it, query_vector).

        A query vector of another length than the stored ones is refused, as it is of another model.
        """
        t = self.store.tables()
        if "query_vector" not in queries.columns:
            made = vector.embedded(queries.withColumn("content", F.col("query")), *self.model, self._embedder())
            queries = settled(made.select(*queries.columns, F.col("embedding").alias("query_vector")))
        stored = self.vectors().filter("embedding is not null").select(F.size("embedding")).first()
        asked = queries.filter("query_vector is not null").select(F.size("query_vector").alias("n")).agg(F.min("n"), F.max("n")).first()
        if stored and asked[0] is not None and {asked[0], asked[1]} != {stored[0]}:
            raise ValueError(f"the model {'-'.join(self.model)} has vectors of length {stored[0]}, the queries of {asked[0]} to {asked[1]}")
        return recall.hybrid_search(t["documents"], t["chunks"], queries, as_of, t["mentions"], self.vectors(), k, settings=self.settings, ranked=self.index.search, **filters)

    def context(self, queries: DataFrame, as_of: str, **filters) -> DataFrame:
        return answer.context_block(answer.within_budget(self.search(queries, as_of, **filters)), queries)

    # Conversations

    def chat(self, asked: DataFrame, as_of: str, generate: Embedder | None = None, **filters) -> DataFrame:
        """One turn each of (query_id, session_id, query, asked_at): retrieve, fill the context, answer, keep both turns.

        Returns query_id, session_id, answer and citations, an array of cards.
        """
        turns = self.store.read("turns") if self.store.has("turns") else self.spark.createDataFrame([], answer.TURNS_DDL)
        found = settled(self.search(asked.select("query_id", "query"), as_of, **filters))
        said = settled(answer.answers(answer.chat_prompts(asked, found, turns), generate))
        self.store.append("turns", answer.new_turns(turns, said))
        cards = answer.citation_cards(found, said).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_index", "chunk_id", "document_id", "snippet", "score"))).alias("citations"))
        return said.select("query_id", "session_id", "answer").join(cards, "query_id", "left")

    def sessions(self, limit: int = 20) -> DataFrame:
        return answer.sessions(self.store.read("turns"), limit)

    def history(self, session_id: int, limit: int = 100) -> DataFrame:
        return answer.history(self.store.read("turns").filter(F.col("session_id") == session_id), limit).orderBy("turn")

    def delete_sessions(self, ids: DataFrame) -> None:
        self.store.delete("turns", "session_id", ids.select("session_id"))

    def purge_turns(self, as_of: str) -> DataFrame:
        """Delete turns past retention; returns their keys."""
        old = settled(protect.expired_turns(self.store.read("turns"), as_of, self.settings).select("session_id", "turn"))
        sessions = old.select("session_id").distinct()
        kept = settled(self.store.read("turns").join(sessions, "session_id", "left_semi").join(old, ["session_id", "turn"], "left_anti"))
        self.store.delete("turns", "session_id", sessions)
        self.store.append("turns", kept)
        return old

    # Graph

    def entities(self, text: str = "", limit: int = 20) -> DataFrame:
        rows = self._names()
        return graph.search(rows, text, limit=limit) if text else graph.top(rows, limit)

    def _names(self) -> DataFrame:
        return graph.entities_of(self.store.read("name_deltas"))

    def _relations(self, min_confidence: float | None = None) -> DataFrame:
        found = graph.relations_of(self.store.read("name_deltas"), self.store.read("pair_deltas"), self.settings.relation_confidence if min_confidence is None else min_confidence)
        return found.select("subject", F.lit("CO_OCCURS").alias("predicate"), "object", "confidence", "n_documents")

    def relations(self, subject: str | None = None, predicate: str | None = None, object_name: str | None = None, min_confidence: float | None = None, limit: int = 100) -> DataFrame:
        return graph.relations_like(self._relations(min_confidence), subject, predicate, object_name, limit)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges."""
        t = self.store.tables()
        return graph.nodes(t["documents"], t["chunks"], t["mentions"]), graph.edges(t["chunks"], t["mentions"], self._relations())

    # Forgetting

    def forget(self, ids: DataFrame, as_of: str) -> DataFrame:
        """Delete documents from every table, the index and the vectors, and log it; returns the verification.

        `documents` comes last, so a run that failed midway can be repeated.
        """
        keys = settled(ids.select("document_id").distinct())
        log = settled(keys.join(self.store.read("documents").select("document_id", "source_type", "source_path"), "document_id", "left").withColumn("forgotten_at", F.lit(as_of)))
        self._clear(keys)
        self.store.delete("documents", "document_id", keys)
        self.store.append("forget_log", log)
        return self.verify_forget(keys)

    def forget_source(self, source_type: str, as_of: str) -> DataFrame:
        return self.forget(self.store.read("documents").filter(F.col("source_type") == source_type), as_of)

    def verify_forget(self, ids: DataFrame) -> DataFrame:
        tables = {name: self.store.read(name) for name in (*self.OF_DOCUMENTS, *self._folders()) if self.store.has(name)}
        return protect.verify_forgotten(tables | {"index": self.index.lengths()}, ids)

    # Models

    LOG_DDL = "at long, model_id string, name string, version string, path string, status string, noted_at string"

    def models(self) -> DataFrame:
        """The registry, from its log."""
        return vector.registry(self.store.read("models") if self.store.has("models") else self.spark.createDataFrame([], self.LOG_DDL))

    def vectors(self) -> DataFrame:
        """Those of the active model."""
        return self.store.read(self._folder(*self.model))

    @staticmethod
    def _folder(model: str, version: str) -> str:
        return f"vectors-{model}-{version}"

    def _folders(self) -> list[str]:
        """The folders of vectors that are there, of any model."""
        known = {self._folder(*self.model), self._folder("hashing", "1"), *(self._folder(r["name"], r["version"]) for r in self.models().collect())}
        return sorted(name for name in known if self.store.has(name))

    def _embedder(self) -> Embedder | None:
        if not self._made:
            raise ValueError(f"the active model is {'-'.join(self.model)}: open the memory with its function")
        return self.embed

    def _note(self, model: str, version: str, status: str, as_of: str) -> None:
        row = (self._last("models") + 1, f"{model}-{version}", model, version, f"{self.store.path}/{self._folder(model, version)}", status, as_of)
        self.store.append("models", self.spark.createDataFrame([row], self.LOG_DDL))

    def cancel_migration(self, model: str, version: str, as_of: str) -> None:
        """Ask a migration that runs, here or elsewhere, to stop after its present step. The active model stays; what is done stays for a resumption."""
        self._note(model, version, "CANCELLED", as_of)

    def migration(self, model: str, version: str) -> DataFrame:
        """Progress: total_chunks, migrated_chunks, progress_pct, status."""
        folder = self._folder(model, version)
        have = self.store.read(folder) if self.store.has(folder) else self.spark.createDataFrame([], "id string")
        return vector.migration_progress(self.store.read("chunks"), have)

    def migrate(self, model: str, version: str, as_of: str, embed: Embedder | None = None, steps: int = 8) -> DataFrame:
        """Embed all chunks with another model into its own folder, validate, and only then make the model active.

        It goes by steps, each a share of the documents and one append: a run that is lost or cancelled leaves the active model
        and its vectors, and the next call embeds only the chunks that have no vector yet. Returns the validation with
        status COMPLETE, FAILED (vectors are null or missing: its folder is dropped) or CANCELLED.
        """
        folder, name = self._folder(model, version), f"{model}-{version}"
        self._note(model, version, "RUNNING", as_of)
        status = "COMPLETE"
        for step in range(steps):
            if self.models().filter(F.col("model_id") == name).first()["status"] == "CANCELLED":
                status = "CANCELLED"
                break
            rest = self.store.scan("chunks").filter(F.pmod("part", F.lit(steps)) == step).drop("part")
            if self.store.has(folder):
                rest = rest.join(self.store.read(folder).select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
            self.store.append(folder, settled(self._embedded(rest, model, version, embed)))
        have = self.store.read(folder) if self.store.has(folder) else self.spark.createDataFrame([], "id string, embedding array<float>")
        result = settled(vector.validated(self.store.read("chunks"), have))
        if status == "COMPLETE" and not result.first()["valid"]:
            status = "FAILED"
            self.store.drop(folder)
        if status != "CANCELLED":
            self._note(model, version, status, as_of)
        if status == "COMPLETE":
            self._note(model, version, "ACTIVE", as_of)
            self.model, self.embed, self._made = (model, version), embed, True
        return result.withColumn("status", F.lit(status))

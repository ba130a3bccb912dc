"""Entities and their graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.reach import densely_numbered, reach
from palimpsest.operators.store import settled

#: Entity type by label; others are concepts.
LABELS = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "PLACE", "LOC": "PLACE"}
_PHRASE = r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[ \t\n\r]+[A-Z][a-z]+)+)(?![A-Za-z0-9_])"
_WORD = r"(?<![A-Za-z0-9_])([A-Z][a-z]+)(?![A-Za-z0-9_])"


def entity_names(text: Column) -> Column:
    """Distinct capitalised phrases and words."""
    return F.array_union(F.regexp_extract_all(text, F.lit(_PHRASE), F.lit(1)), F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)))


def entity_type(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), label), F.lit("CONCEPT"))


def mentions(docs: DataFrame, text: str = "text", extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """document_id, name, captured_at, entity_type; one row per document and entity.

    extract: a column function from text to array<struct<name, label>>, say a Pandas UDF around a model; labels map to entity
    types. The default takes capitalised words and phrases as concepts.
    """
    if extract is None:
        found = docs.select("document_id", "captured_at", F.explode(entity_names(F.col(text))).alias("name"))
        return found.select("document_id", F.trim("name").alias("name"), "captured_at", F.lit("CONCEPT").alias("entity_type"))
    found = docs.select("document_id", "captured_at", F.explode(extract(F.col(text))).alias("entity"))
    return found.select("document_id", F.trim("entity.name").alias("name"), "captured_at", entity_type(F.col("entity.label")).alias("entity_type")).filter("name <> ''").distinct()


def rollup(mention_rows: DataFrame) -> DataFrame:
    """canonical_name, entity_type, first_seen, last_seen, mention_count."""
    return mention_rows.groupBy(F.col("name").alias("canonical_name"), "entity_type").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"), F.count("*").alias("mention_count"))


def upsert(entities: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored entities merged with a batch's roll-up on (canonical_name, entity_type)."""
    both = entities.unionByName(batch)
    return both.groupBy("canonical_name", "entity_type").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("mention_count").alias("mention_count"))


def search(entities: DataFrame, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Names that hold the text, any case; by name."""
    rows = entities.filter(F.contains(F.lower("canonical_name"), F.lit(text.lower())))
    return (rows.filter(F.col("entity_type") == kind) if kind else rows).orderBy("canonical_name", "entity_type").limit(limit)


def top(entities: DataFrame, limit: int = 20) -> DataFrame:
    return entities.orderBy(F.desc("mention_count"), "canonical_name").limit(limit)


def neighbours(names: DataFrame, mention_rows: DataFrame, hops: int = 1) -> DataFrame:
    """Distinct (query_id, document_id) of documents that mention the names (query_id, name); more hops go over shared names."""
    links = mention_rows.select("document_id", "name")
    return reach(names, links, hops) if hops > 1 else names.join(links, "name").select("query_id", "document_id").distinct()


def detail(mention_rows: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Documents of one entity with their source and capture time."""
    return mention_rows.filter(F.col("name") == name).select("name", "document_id").join(docs.select("document_id", "source_type", "source_path", "captured_at"), "document_id")


def cooccurrences(mention_rows: DataFrame, min_confidence: float = 0.5, min_documents: int = 2) -> DataFrame:
    """subject, object, n_documents, confidence: names met in the same documents, confidence n / documents of the subject.

    Names in fewer than min_documents documents go before pairs are made. Each pair is counted once, by the numbers of its names, and
    gets its names and both directions when what is below min_documents is gone.
    """
    own = numbered(mention_rows.groupBy("name").agg(F.count("*").alias("own")).filter(F.col("own") >= min_documents))
    held = settled(mention_rows.select("document_id", "name").join(own, "name").select("document_id", "number", "own"))
    pairs = held.join(held.select("document_id", F.col("number").alias("other"), F.col("own").alias("_all")), "document_id").filter("number < other")
    both = pairs.groupBy("number", "other").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= min_documents)
    return _named(both, own, min_confidence)


def numbered(names: DataFrame) -> DataFrame:
    """names with a number each: pairs of numbers take a fraction of the memory of pairs of names."""
    return settled(names.withColumn("number", F.monotonically_increasing_id()))


def _named(both: DataFrame, own: DataFrame, min_confidence: float) -> DataFrame:
    """Relations of both directions from (number, other, n_documents), each pair once."""
    ways = both.select("n_documents", F.explode(F.array(F.struct("number", "other"), F.struct(F.col("other").alias("number"), F.col("number").alias("other")))).alias("way"))
    rated = ways.select("way.number", "way.other", "n_documents").join(own, "number").withColumn("confidence", F.col("n_documents") / F.col("own")).filter(F.col("confidence") >= min_confidence)
    named = rated.withColumnRenamed("name", "subject").drop("own").join(own.select(F.col("number").alias("other"), F.col("name").alias("object")), "other")
    return named.select("subject", "object", "n_documents", "confidence")


def name_deltas(mention_rows: DataFrame, sign: int = 1) -> DataFrame:
    """name, entity_type, n, first_seen, last_seen, reset: what the given mentions add to the counts, or (sign -1) take from them."""
    rows = mention_rows.groupBy("name", "entity_type").agg((F.lit(sign) * F.count("*")).alias("n"), F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
    return rows.withColumn("reset", F.lit(False))


def pair_deltas(mention_rows: DataFrame, sign: int = 1, summed: bool = True) -> DataFrame:
    """low, high, n of each two names of a document. Each document's pairs add up in the tasks before they are shuffled. summed: false leaves a row per document to whoever adds up several changes."""
    own = mention_rows.select("document_id", "name")
    pairs = own.withColumnRenamed("name", "low").join(own.withColumnRenamed("name", "high"), "document_id").filter("low < high")
    if not summed:
        return pairs.select("low", "high", F.lit(sign).cast("long").alias("n"))
    return pairs.groupBy("low", "high").agg((F.lit(sign) * F.count("*")).alias("n"))


def entities_of(deltas: DataFrame) -> DataFrame:
    """As `rollup`, from name deltas with the number of their change (at). The times of a name count from its last reset on."""
    last = F.max(F.when(F.col("reset"), F.col("at"))).over(Window.partitionBy("name", "entity_type"))
    fresh = deltas.withColumn("last", F.coalesce(last, F.lit(0))).withColumn("counts", (F.col("at") >= F.col("last")) & (F.col("n") >= 0))
    times = [F.min(F.when(F.col("counts"), F.col("first_seen"))).alias("first_seen"), F.max(F.when(F.col("counts"), F.col("last_seen"))).alias("last_seen")]
    return fresh.groupBy(F.col("name").alias("canonical_name"), "entity_type").agg(*times, F.sum("n").alias("mention_count")).filter("mention_count > 0")


def resets(entities: DataFrame, gone: DataFrame, left: DataFrame) -> DataFrame:
    """Name deltas with the times of names whose first or last mention is among the gone ones, from the mentions left. entities: before they went."""
    touched = gone.select(F.col("name").alias("canonical_name"), "entity_type", F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"), "n")
    ends = entities.join(touched, ["canonical_name", "entity_type"]).filter((F.col("mention_count") + F.col("n") > 0) & ((F.col("_first") <= F.col("first_seen")) | (F.col("_last") >= F.col("last_seen"))))
    again = left.join(ends.select(F.col("canonical_name").alias("name"), "entity_type"), ["name", "entity_type"], "left_semi")
    return name_deltas(again).withColumns({"n": F.lit(0).cast("long"), "reset": F.lit(True)})


def relations_of(names: DataFrame, pairs: DataFrame, min_confidence: float = 0.5, min_documents: int = 2) -> DataFrame:
    """As `cooccurrences`, from name and pair deltas."""
    own = names.groupBy("name").agg(F.sum("n").alias("own"))
    both = pairs.groupBy("low", "high").agg(F.sum("n").alias("n_documents")).filter(F.col("n_documents") >= min_documents)
    ways = both.select("n_documents", F.explode(F.array(F.struct(F.col("low").alias("subject"), F.col("high").alias("object")), F.struct(F.col("high").alias("subject"), F.col("low").alias("object")))).alias("way"))
    rated = ways.select("way.subject", "way.object", "n_documents").join(own, F.col("subject") == F.col("name")).withColumn("confidence", F.col("n_documents") / F.col("own"))
    return rated.filter(F.col("confidence") >= min_confidence).select("subject", "object", "n_documents", "confidence")


def relations_after(changes: list[tuple[DataFrame, int]], min_confidence: float = 0.5, min_documents: int = 2) -> DataFrame:
    """As `relations_of`, from changes that are not kept: (mentions, 1 or -1) of each.

    Names that are in fewer than min_documents documents after all changes go before pairs are made, as no pair of theirs can be in
    more. A pair is one number of 8 bytes, and the signed rows of all changes add up at once. Pairs are made in slices by their lower
    name, as many as there are pairs for, so a task's sums fit its memory at any size.
    """
    names = reduce(DataFrame.unionByName, (name_deltas(rows, sign).select("name", "n") for rows, sign in changes))
    own = settled(densely_numbered(names.groupBy("name").agg(F.sum("n").alias("own")).filter(F.col("own") >= min_documents)).withColumnRenamed("_number", "number"))
    signed = (rows.select("document_id", "name", F.lit(at).alias("at"), F.lit(sign).cast("long").alias("n")) for at, (rows, sign) in enumerate(changes))
    held = settled(reduce(DataFrame.unionByName, signed).join(own, "name").select("document_id", "at", "n", "number"))
    made = held.groupBy("document_id", "at").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    slices = max(1, -(-int(made) // (TASK_PAIRS * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    higher = held.select("document_id", "at", F.col("number").alias("other"))
    pair = F.shiftleft("number", 32).bitwiseOR(F.col("other")).alias("pair")

    def summed(lower: DataFrame) -> DataFrame:
        pairs = lower.join(higher, ["document_id", "at"]).filter("number < other")
        return pairs.groupBy(pair).agg(F.sum("n").alias("n_documents")).filter(F.col("n_documents") >= min_documents)

    both = reduce(DataFrame.unionByName, (summed(held.filter(F.col("number") % slices == k)) for k in range(slices)))
    return _named(both.select(F.shiftright("pair", 32).alias("number"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("other"), "n_documents"), own, min_confidence)


TASK_PAIRS = 2_000_000  #: pairs of a task, some 90 bytes each where all differ


def relations_like(relations: DataFrame, subject: str | None = None, predicate: str | None = None, object_name: str | None = None, limit: int = 100) -> DataFrame:
    """Relations (subject, predicate, object, confidence) that hold the given texts, any case, most confident first; 1 to 100 rows."""
    for column, text in (("subject", subject), ("predicate", predicate), ("object", object_name)):
        if text:
            relations = relations.filter(F.contains(F.lower(column), F.lit(text.lower())))
    return relations.orderBy(F.desc("confidence"), "subject", "predicate", "object").limit(max(1, min(limit, 100)))


def nodes(docs: DataFrame, chunks: DataFrame, mention_rows: DataFrame) -> DataFrame:
    """kind, id of every node: documents, entities, and the chunks of documents that have an entity."""
    node = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    linked = chunks.join(mention_rows.select("document_id").distinct(), "document_id", "left_semi")
    return node(docs, "Document", "document_id").unionByName(node(linked, "Chunk", "chunk_id")).unionByName(node(mention_rows, "Entity", "name")).distinct()


def edges(chunks: DataFrame, mention_rows: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """kind, src, dst, confidence of every edge: MENTIONED_IN (entity to document), CONTAINS (document to chunk, where it has an entity), RELATED_TO."""
    edge = lambda df, kind, src, dst, weight: df.select(F.lit(kind).alias("kind"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), weight.alias("confidence"))
    one, linked = F.lit(1.0), chunks.join(mention_rows.select("document_id").distinct(), "document_id", "left_semi")
    out = edge(mention_rows, "MENTIONED_IN", "name", "document_id", one).unionByName(edge(linked, "CONTAINS", "document_id", "chunk_id", one))
    return (out if relations is None else out.unionByName(edge(relations, "RELATED_TO", "subject", "object", F.col("confidence")))).distinct()


def merged_nodes(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Stored nodes and those of more that are not among them: the first write of a node stays."""
    return stored.unionByName(more.dropDuplicates(["kind", "id"]).join(stored.select("kind", "id"), ["kind", "id"], "left_anti"))


def merged_edges(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Stored edges and those of more that differ in any property."""
    return stored.unionByName(more).distinct()


def without_documents(edge_rows: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges less those at the documents and at their chunks."""
    gone = ids.select(F.col("document_id").cast("string").alias("_end")).unionByName(chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi").select(F.col("chunk_id").cast("string").alias("_end"))).distinct()
    for end, kinds in (("src", ("CONTAINS",)), ("dst", ("CONTAINS", "MENTIONED_IN"))):
        edge_rows = edge_rows.join(gone, (F.col(end) == F.col("_end")) & F.col("kind").isin(*kinds), "left_anti")
    return edge_rows


def counts(entities: DataFrame, mention_rows: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: n_entities, n_mentions, n_documents, n_chunks."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
    rows = one(entities, "n_entities").unionByName(one(mention_rows, "n_mentions")).unionByName(one(docs, "n_documents")).unionByName(one(chunks, "n_chunks"))
    return rows.groupBy().pivot("k", ["n_entities", "n_mentions", "n_documents", "n_chunks"]).agg(F.first("n"))

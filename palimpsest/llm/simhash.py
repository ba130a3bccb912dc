"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at most 4 bits share at least
8 - 4 = 4 of them. Postings of one positional byte hold 1/256 of all rows, so their pairs would grow with the
square of the input; the index therefore intersects postings three by three. The 20 position triples used
meet every set of 4 positions (a Turan system on 8 points), so each pair that reaches the minimum meets in a
posting of about N/2^24 fingerprints. There the shared positional bytes of a pair are tallied, pairs under the
minimum dropped, and the rest verified by their differing bits.

Work is on distinct fingerprints, so copies cost one row each. Postings emit links that span their classes, not
all pairs. A posting over `dense_run` fingerprints is too large for pairs: each of its members instead emits all
values at two or fewer flipped bits outside the shared bytes, and two fingerprints within 4 bits meet in one of
them, so no link is lost at any group size.

Defined cases. Null or empty text, or one without words: fingerprint 0, linked like any other. Fewer words than
a shingle: the whole sequence is the shingle. Repeated rows and doc_ids: each row is reported; component_id is
the least doc_id of its class. Other columns are ignored by `near_duplicates` and kept by `drop_near_copies`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import GOLDEN, Batches, carried, checkpointed, mix, rows_to_batch, slices, texts_of
from palimpsest.llm.components import connected_components

SHINGLE, SEED, MAX_BITS, BYTES = 4, 42, 4, 8
MIN_SHARED = BYTES - MAX_BITS
SMALL_RUN, DENSE_RUN = 32, 32_768


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that any 4 positions hold one: positions in three rings of 3, 3 and 2;
    triples within a ring, and those with two positions in a ring and one in the next."""
    ring = [0, 0, 0, 1, 1, 1, 2, 2]
    chosen = []
    for t in combinations(range(BYTES), 3):
        count = [sum(ring[p] == r for p in t) for r in range(3)]
        if 3 in count or any(count[r] == 2 and count[(r + 1) % 3] == 1 for r in range(3)):
            chosen.append(t)
    return chosen


TRIPLES = position_triples()


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of the lower-cased text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles."""
    return majority(shingle_hashes(text, size, seed))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half of the shingle hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


_ROWS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for each row."""

    def run(batches: Batches) -> Batches:
        for b in slices(batches):
            yield rows_to_batch(_ROWS, [b.column("doc_id"), [fingerprint(t, size, seed) for t in texts_of(b.column("text"))]])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, fp long")


def reach_minimum(x: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """Count filter, then verification, over XORs of pairs: at least `least` shared positional bytes, few differing bits."""
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    return (shared >= least) & (np.bitwise_count(x) <= max_bits)


def _spanning_links(f: np.ndarray, max_bits: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of links that span the classes of one posting: a breadth-first walk that leaves found members out."""
    links, rest = [], np.arange(len(f))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = reach_minimum(f[rest] ^ f[at], max_bits, least)
            if near.any():
                found, rest = rest[near], rest[~near]
                links.append((np.full(len(found), at), found))
                queue += list(found)
    return links


def _flips(triple: tuple[int, ...], radius: int) -> np.ndarray:
    """All masks of at most `radius` bits outside the triple's bytes."""
    bits = [np.uint64(1) << np.uint64(8 * p + i) for p in range(BYTES) if p not in triple for i in range(8)]
    masks = [np.uint64(0)]
    for r in range(1, radius + 1):
        masks += [np.bitwise_or.reduce(np.array(c, np.uint64)) for c in combinations(bits, r)]
    return np.array(masks, np.uint64)


_PAIRS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def posting_links(max_bits: int, least: int, small_run: int):
    """Task over (posting, fp, node) rows sorted by (posting, fp): (src, dst) nodes that span the classes of each posting."""

    def whole(key: np.ndarray, f: np.ndarray, nodes: np.ndarray) -> Batches:
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        sizes = ends - starts
        for i in np.flatnonzero(sizes > small_run).tolist():
            own = nodes[starts[i] : ends[i]]
            for a, b in _spanning_links(f[starts[i] : ends[i]], max_bits, least):
                yield rows_to_batch(_PAIRS, [own[a], own[b]])
        small = np.repeat((sizes > 1) & (sizes <= small_run), sizes)
        k, v, n = key[small], f[small], nodes[small]
        for lag in range(1, small_run):
            at = np.flatnonzero(k[lag:] == k[:-lag]) if lag < len(k) else np.empty(0, np.int64)
            if not len(at):
                break
            at = at[reach_minimum(v[at] ^ v[at + lag], max_bits, least)]
            if len(at):
                yield rows_to_batch(_PAIRS, [n[at], n[at + lag]])

    def run(batches: Batches) -> Batches:
        keys, fps, nodes = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            nodes = np.concatenate((nodes, b.column(2).to_numpy(zero_copy_only=False)))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield from whole(keys[:last], fps[:last], nodes[:last])
                keys, fps, nodes = keys[last:], fps[last:], nodes[last:]
        if len(keys):
            yield from whole(keys, fps, nodes)

    return run


_FLIPPED = pa.schema([("posting", pa.int64()), ("value", pa.int64()), ("node", pa.int64())])


def flipped_values(radius: int):
    """Task over (posting, fp, node) rows in any order: each row's values at up to `radius` flipped bits outside the shared bytes."""
    masks = [_flips(t, radius) for t in TRIPLES]

    def run(batches: Batches) -> Batches:
        for b in slices(batches, 256):
            keys, fps = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for triple in np.unique(keys >> 24).tolist():
                own = np.flatnonzero(keys >> 24 == triple)
                values = (fps[own, None].view(np.uint64) ^ masks[triple][None, :]).ravel().view(np.int64)
                at = pa.array(np.repeat(own, len(masks[triple])))
                yield rows_to_batch(_FLIPPED, [b.column(0).take(at), values, b.column(2).take(at)])

    return run


def posting_keys(fp: Column) -> Column:
    """The postings of a fingerprint: triple, and the triple's three bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    return F.array(*(F.lit(k << 24).cast("long") + byte[a] * 65536 + byte[b] * 256 + byte[c] for k, (a, b, c) in enumerate(TRIPLES)))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, dense_run: int = DENSE_RUN) -> DataFrame:
    """(src, dst) links over distinct fingerprints (column fp) whose components are those of all pairs within max_bits.

    Postings of up to dense_run fingerprints are walked through in a task. The members of larger ones stay where they are: each
    emits its flipped values, and the least member of each value is linked with the others; counts and minima combine before their shuffle.
    """
    postings = fps.select(F.explode(posting_keys(F.col("fp"))).alias("posting"), "fp")
    sizes = postings.groupBy("posting").agg(F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(postings.join(sizes, "posting").select("posting", "fp", "n"))
    walked = members.filter(F.col("n") <= dense_run).repartition("posting").sortWithinPartitions("posting", "fp").select("posting", "fp", F.col("fp").alias("node"))
    links = walked.mapInArrow(posting_links(max_bits, MIN_SHARED, SMALL_RUN), "src long, dst long")
    dense = members.filter(F.col("n") > dense_run).select("posting", "fp", F.col("fp").alias("node"))
    flipped = dense.mapInArrow(flipped_values(max_bits // 2), "posting long, value long, node long")
    roots = flipped.groupBy("posting", "value").agg(F.min("node").alias("root"))
    return links.unionByName(flipped.join(roots, ["posting", "value"]).filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS, dense_run: int = DENSE_RUN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of docs."""
    if max_bits not in range(0, MAX_BITS + 1, 2):
        raise ValueError(f"max_bits is even and at most {MAX_BITS}: the position triples are made for {MIN_SHARED} shared bytes, the flips for two equal halves")
    rows = checkpointed(fingerprints(docs, size, seed))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(fingerprint_links(distinct.select("fp"), max_bits, dense_run)).withColumnRenamed("node", "fp")
    classes = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies: least similarity of the sets of five-word shingles; bands of minima that make a pair a candidate. A pair
#: of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 24, 3 in a million.
MIN_SIMILARITY, BANDS, BAND_MINIMA = 0.8, 24, 4
#: Documents of a posting whose pairs are tested by joins; shingles of a block of a larger posting.
SMALL_POSTING, BLOCK_SHINGLES = 8, 1 << 21
#: Words of 64 bits that tell which documents may be among chosen ones: the most rows of a broadcast.
FILTER_WORDS = 1 << 18
_BANDED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def node_of(hashes: np.ndarray) -> int:
    """Signed 64-bit hash of a set of shingle hashes."""
    return int(mix(np.array([mix(hashes).sum(dtype=np.uint64)]) + np.full(1, len(hashes), np.uint64) * GOLDEN).view(np.int64)[0])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band of a set of shingle hashes: the minima of the set under BAND_MINIMA multipliers. None for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    factors = mix(np.arange(1, BANDS * BAND_MINIMA + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, np.multiply.outer(factors, hashes[k : k + 4096]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64) * GOLDEN
    for minima in least.reshape(BANDS, BAND_MINIMA).T:
        keys = mix(keys + minima)
    return keys.view(np.int64)


NO_ID = (1 << 63) - 1  #: stands for a null doc_id: the last to stay


def banded(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, node, size, fp, bands) of each row: hash, size and SimHash of its set of shingles, and its band keys."""

    def run(batches: Batches) -> Batches:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, size)) for t in texts_of(b.column("text"))]
            yield rows_to_batch(_BANDED, [b.column("doc_id"), b.column("text_key"), [node_of(x) for x in sets], [len(x) for x in sets], [majority(x) for x in sets], [band_keys(x) for x in sets]])

    return _with_keys(docs).mapInArrow(run, "doc_id long, text_key long, node long, size long, fp long, bands array<long>")


def _with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with `marked`: false only where (doc_id, text_key) is none of the keys, so that the others need no shuffle to be told apart."""
    hashed = F.xxhash64("doc_id", "text_key")
    word, bit = hashed.bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("_word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id, text_key), 40) & 63 as int))")
    bits = keys.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")  # FILTER_WORDS rows at most
    return found.withColumn("marked", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst) candidates among nodes (node, size, fp): links of the byte-position index that span all fingerprints within MAX_BITS, and nodes of one fingerprint."""
    own = nodes.filter("size > 0").select("node", "fp")
    heads = checkpointed(own.groupBy("fp").agg(F.min("node").alias("head")))
    links = fingerprint_links(heads.select("fp"))
    for end in ("src", "dst"):
        links = links.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_node")), end)
    same = own.join(heads, "fp").filter("node <> head").select(F.col("node").alias("src_node"), F.col("head").alias("dst_node"))
    both = links.select("src_node", "dst_node").unionByName(same)
    return both.select(F.least("src_node", "dst_node").alias("src"), F.greatest("src_node", "dst_node").alias("dst"))


def shingle_sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the chosen (node, doc_id, text_key)."""

    def run(batches: Batches) -> Batches:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, size)) for t in texts_of(b.column("text"))]
            own = [(n, x.view(np.int64)) for n, x in zip(b.column("node").to_pylist(), sets, strict=True) if node_of(x) == n]
            yield rows_to_batch(_SETS, [[n for n, _ in own], [x for _, x in own]])

    return _marked(_with_keys(docs), chosen).filter("marked").join(chosen, ["doc_id", "text_key"]).select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def similar_links(sets: list[np.ndarray], min_similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of links that span the classes of similar sets, none empty: a walk as in `_spanning_links`, by exact similarity."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = [codes[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    links, mark = [], np.zeros(int(codes.max()) + 1, bool)
    rest, held = np.arange(1, len(sets)), codes[sizes[0] :]
    queue = [0]
    while len(rest):
        if not queue:
            queue, held, rest = [int(rest[0])], held[sizes[rest[0]] :], rest[1:]
            continue
        at = queue.pop()
        mark[own[at]] = True
        shared = np.add.reduceat(mark[held], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
        mark[own[at]] = False
        near = shared / (sizes[rest] + sizes[at] - shared) >= min_similarity
        if near.any():
            found, held, rest = rest[near], held[np.repeat(~near, sizes[rest])], rest[~near]
            links.append((np.full(len(found), at), found))
            queue += found.tolist()
    return links


def unit_links(min_similarity: float):
    """Task over (unit, node, shingles) rows sorted by unit: (src, dst) links that span the classes of each unit."""

    def whole(nodes: list[int], sets: list[np.ndarray]) -> Batches:
        names = np.array(nodes, np.int64)
        for a, b in similar_links(sets, min_similarity) if len(nodes) > 1 else []:
            yield rows_to_batch(_PAIRS, [names[a], names[b]])

    def run(batches: Batches) -> Batches:
        unit, nodes, sets = None, [], []
        for b in slices(batches):
            for u, n, x in zip(b.column("unit").to_pylist(), b.column("node").to_pylist(), b.column("shingles"), strict=True):
                if u != unit:
                    yield from whole(nodes, sets)
                    unit, nodes, sets = u, [], []
                nodes.append(n)
                sets.append(x.values.to_numpy(zero_copy_only=False).copy())
        yield from whole(nodes, sets)

    return run


def copy_classes(docs: DataFrame, size: int = 5, min_similarity: float = MIN_SIMILARITY, small_posting: int = SMALL_POSTING, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, text_key, least) of each row, least being the struct(doc_id, text_key) that comes first in its class.

    Two documents are similar by the sets of their word shingles: shared / all of both, 0.8 or more by default.

    Documents with equal sets are one node. Candidates come first from the SimHash of the sets, through the byte-position
    index with its count filter; as 64 bits cannot guarantee a similarity of 0.8 (such sets differ by 10 bits on average), bands
    of minima complete them. All are decided by the exact similarity. Nodes that share a band of minima meet in its posting. Every pair of a
    posting of up to `small_posting` nodes is tested on the shingle sets by joins. The nodes of a larger one are dealt into
    blocks of about `block` shingles, and each two blocks into a task that emits links which span the similar pairs there.
    So each pair that meets is decided by its exact similarity at any size of posting. Classes are connected components.
    """
    rows = checkpointed(banded(docs, size))
    nodes = rows.groupBy("node", "size", "fp", "bands").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    nodes = checkpointed(nodes)
    postings = nodes.select("node", "size", F.explode("bands").alias("posting"))
    shared = postings.groupBy("posting").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *(F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"of_{k}") for k in (0, 1))).filter("n > 1")
    # Copies meet in up to all of their bands: of postings with the same nodes (by 128 bits) one is enough.
    shared = shared.groupBy("n", "total", "of_0", "of_1").agg(F.min("posting").alias("posting")).select("posting", "n", "total")
    members = checkpointed(postings.join(shared, "posting"))
    left, right = (members.filter(F.col("n") <= small_posting).select("posting", F.col("node").alias(c), F.col("size").alias(f"{c}_size")) for c in ("src", "dst"))
    fits = (F.col("src_size") >= F.col("dst_size") * (min_similarity - 1e-6)) & (F.col("dst_size") >= F.col("src_size") * (min_similarity - 1e-6))
    banded_pairs = left.join(right, "posting").filter((F.col("src") < F.col("dst")) & fits).select("src", "dst")
    pairs = checkpointed(simhash_pairs(nodes).unionByName(banded_pairs).distinct())
    large = members.filter(F.col("n") > small_posting).select("posting", "node", F.ceil(F.col("total") / block).alias("blocks"))
    needed = pairs.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(large.select("node")).distinct()
    sets = checkpointed(shingle_sets(docs, checkpointed(nodes.select("node", "first.*").join(needed, "node", "left_semi")), size))
    for end in ("src", "dst"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_shingles")), end)
    both = F.size(F.array_intersect("src_shingles", "dst_shingles"))
    tested = pairs.filter(both / (F.size("src_shingles") + F.size("dst_shingles") - both) >= min_similarity).select("src", "dst")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    units = large.select("posting", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    units = units.select(F.xxhash64("posting", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "node")
    dealt = units.join(sets, "node").select("unit", "node", "shingles").repartition("unit").sortWithinPartitions("unit")
    links = tested.unionByName(dealt.mapInArrow(unit_links(min_similarity), "src long, dst long"))
    parts = connected_components(links)
    classes = nodes.select("node", "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    return rows.select("doc_id", "text_key", "node").join(classes.select("node", "component").join(least, "component"), "node").select("doc_id", "text_key", "least")


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, component_id) of each row: the least doc_id of its class of near copies."""
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    return copy_classes(docs, **options).select(named(F.col("doc_id")).alias("doc_id"), named(F.col("least.doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs less every row that is not the first of its class of near copies by doc_id, then text; all columns kept.

    Rows of one doc_id with other texts are judged apart; rows equal in both are one document and stay or go together.
    Rows without a doc_id come last.
    """
    copies = checkpointed(copy_classes(docs, **options).filter(F.struct("doc_id", "text_key") != F.col("least")).select("doc_id", "text_key").distinct())
    keyed = carried(docs).withColumns({"doc_id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)), "text_key": F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))})
    marked = _marked(keyed, copies)
    left = marked.filter("marked").join(copies, ["doc_id", "text_key"], "left_anti")
    return marked.filter("not marked").select("row.*").unionByName(left.select("row.*"))

"""Best-fit packing by exact-complement hashing.

Documents are token sequences that end with id 0; longer ones than the capacity are cut, the first piece taking
the remainder. Full pieces are sequences of their own. For the rest only the histogram of lengths (fewer entries
than the capacity) goes to the driver. For each length from the longest, the gap it leaves is looked up among
available single lengths; then, again from the longest, among pairs and last among triples that sum to it, large parts
first. What fills gaps exactly is consumed as often as counts allow, as one pattern with a multiplicity. Residuals
are then placed best-fit, longest first. Pairs and triples spend short lengths that the residuals may need more: the
last ones are given back for as long as that saves sequences (a single complement never costs one). The plan is
a table of (length, first rank, sequence, offset) intervals; pieces find their place by their rank within their length.

Ranks come from counts per (length, salt), so that no task holds all pieces of one common length.

Defined cases. Null or empty text: one piece of length 1 (id 0). Repeated rows: each is packed. A text of any
length gives its pieces. Empty table: no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches, checkpointed, rows_to_batch, slices, texts_of

CAPACITY, END_ID = 2048, 0
#: Fixed value: the vocabulary's one special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_UNSAFE = re.compile(r" \s|\s |^\s|\s$")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: All bytes but those that can be, or begin, white space other than space and line feed.
_COMMON = bytes(c for c in range(256) if c not in {9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3})
CACHE = 500_000


@lru_cache(maxsize=2)
def _encoding(ranks_path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _single_spaces(text: str) -> bool:
    """Whether each space stands between two characters that are not white space."""
    if text.encode("utf-8", "surrogatepass").translate(None, _COMMON):
        return not _UNSAFE.search(text)
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text)


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    A word that stands between single spaces is encoded alike wherever it is, so its ids are kept, in a cache of
    bounded size.
    """

    def __init__(self, ranks_path: str) -> None:
        self.encode = _encoding(ranks_path).encode_ordinary
        self.words: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ") if _single_spaces(text) else _SAFE_SPACE.split(text)
        words = self.words
        if len(words) > CACHE:
            words.clear()
        for w in set(rest).difference(words):
            words[w] = self._raw(" " + w)
        return self._raw(first) + b"".join(map(words.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self._plain(text)
        return SPECIAL_ID.to_bytes(4, "little").join(map(self._plain, text.split(SPECIAL)))


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, end id included."""
    ids += END_ID.to_bytes(4, "little")
    n = len(ids) // 4
    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row."""

    def run(batches: Batches) -> Batches:
        encoder = Encoder(ranks_path)
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            rows = [(i, *p) for i, t in zip(ids, texts_of(b.column("text")), strict=True) for p in pieces_of(encoder.ids(t), capacity)]
            yield rows_to_batch(_PIECES, [list(c) for c in zip(*rows, strict=True)] or [[]] * 5)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _usable(counts: np.ndarray, parts: tuple[int, ...]) -> int:
    """How often the parts can be taken together."""
    return min(int(counts[p]) // parts.count(p) for p in set(parts))


def _take(counts: np.ndarray, parts: tuple[int, ...]) -> int:
    m = _usable(counts, parts)
    for p in parts:
        counts[p] -= m
    return m


def _fillers(counts: np.ndarray, gap: int, size: int):
    """Combinations of `size` available lengths that sum to gap, long parts first; counts may change meanwhile."""
    if size == 1:
        yield (gap,)
    elif size == 2:
        for a in range(gap - 1, (gap - 1) // 2, -1):
            if counts[a] and counts[gap - a]:
                yield a, gap - a
    else:
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if not counts[a]:
                continue
            rest = gap - a
            b = np.arange(max((rest + 1) // 2, 1), min(a, rest - 1) + 1)
            for x in b[(counts[b] > 0) & (counts[rest - b] > 0)][::-1].tolist():
                if not counts[a]:
                    break
                if counts[x] and counts[rest - x]:
                    yield a, x, rest - x


Patterns = list[tuple[tuple[int, ...], int]]  #: (lengths, how many sequences)


def _complements(counts: np.ndarray, capacity: int, size: int) -> Patterns:
    """Exact complements of `size` lengths for each length from the longest; what they use leaves counts."""
    patterns: Patterns = []
    for longest in range(capacity, 0, -1):
        gap = capacity - longest
        if not counts[longest] or gap < size:
            continue
        for parts in _fillers(counts, gap, size):
            # a filler may hold the longest length itself
            if _usable(counts, (longest, *parts)) > 0:
                patterns.append(((longest, *parts), _take(counts, (longest, *parts))))
            if not counts[longest]:
                break
    return patterns


def _best_fit(counts: np.ndarray, capacity: int) -> Patterns:
    """Lengths from the longest, each into the fullest sequence that still holds it."""
    open_bins: dict[int, Patterns] = {}
    gaps = np.zeros(capacity + 1, np.int64)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                parts, n = open_bins[gap].pop()
                m = min(n, left)
                if n > m:
                    open_bins[gap].append((parts, n - m))
                gaps[gap] -= m
            else:
                gap, parts = capacity, ()
                m = left if 2 * length > capacity else max(1, left // (capacity // length))
            left -= m
            open_bins.setdefault(gap - length, []).append(((*parts, length), m))
            gaps[gap - length] += m
    return [x for bins in open_bins.values() for x in bins]


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """Patterns for a histogram of lengths below the capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    singles = _complements(counts, capacity, 1)
    free = counts.copy()
    combined = [*_complements(counts, capacity, 2), *_complements(counts, capacity, 3)]
    number = lambda patterns: sum(m for _, m in patterns)

    def residual(k: int) -> tuple[int, Patterns]:
        """Sequences of the first k combinations and the rest, and the rest as placed."""
        left = free.copy()
        for parts, m in combined[:k]:
            for p in parts:
                left[p] -= m
        rest = _best_fit(left, capacity)
        return number(combined[:k]) + number(rest), rest

    keep, (best, rest) = len(combined), residual(len(combined))
    low, high = 0, len(combined)  # fewest combinations, and most, that may still be the ones to keep
    least, all_back = residual(0)
    if least < best:
        keep, best, rest = 0, least, all_back
        while high - low > 1:
            k = (low + high) // 2
            total, placed = residual(k)
            if total <= best:
                low, keep, best, rest = k, k, total, placed
            else:
                high = k
    return [*singles, *combined[:keep], *rest]


def interval_table(patterns: list[tuple[tuple[int, ...], int]], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted first global ranks of intervals, their first sequence and their offset; base: first global rank of each length."""
    nxt, sequence, rows = base.copy(), 0, []
    for parts, m in patterns:
        offset = 0
        for p in parts:
            rows.append((int(nxt[p]), sequence, offset))
            nxt[p] += m
            offset += p
        sequence += m
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3


def best_fit_packing(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece."""
    pieces = checkpointed(token_pieces(docs, ranks_path, capacity).withColumn("row_key", F.monotonically_increasing_id()))
    short = pieces.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)))
    counts = short.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # below `capacity` rows
    base = np.zeros(capacity + 1, np.int64)
    for length in range(1, capacity):
        base[length + 1] = base[length] + histogram.get(length, 0)
    starts, sequences, offsets = interval_table(pack_lengths(histogram, capacity), base)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = short.join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_key")) - 1)

    def place(batches: Batches) -> Batches:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = base[length] + rank
            k = np.searchsorted(starts, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequences[k] + at - starts[k]), pa.array(offsets[k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = pieces.filter(F.col("length") == capacity).select(*names, (-1 - F.col("row_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)

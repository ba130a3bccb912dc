"""Exact top-k inner products through a bit-sliced index.

Each block of candidates keeps, per component, bitmaps of the top bits of its quantised values: bit slices. For a
query, quantised too, the score of all rows of a block is added up with bitmap arithmetic: slices of equal weight
are reduced three to two by carry-save adders until one bitmap is left per weight. The k-th best approximate score is
then read off from the most significant slice downward. What quantisation left out is bounded by the norms of the
remainders, so the rows that can still be among the best are those within twice the bound: these
boundary rows, found by comparing slices with a constant, are resolved with exact integers.

The query set is set against all rows in cells of a grid (candidate block x query block): rows are dealt by hash
to blocks, queries repeated for each candidate block and candidates for each query block, and a cell returns k rows a query.

Defined cases. Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of unequal
length: missing components are 0. Repeated rows are candidates each; a query leaves out every row of its own vec_id;
a vec_id with several vectors is one query each. Ties go to the smaller vec_id. Fewer rows than k: all of them.
Null vec_id: a candidate that sorts last, never a query. Components whose products could leave 64 bits are added up as
unbounded integers without an index; a score beyond 64 bits is given as the nearest 64-bit number. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES, QUERY_BITS = 6, 6
BLOCK_ROWS, QUERY_ROWS = 8192, 8192
_SCALE = 256.0


def carry_save(planes: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps of the binary digits, least first, of the per-row sum of weighted bitmaps (weight 2^key)."""
    out, weight = [], 0
    pending = {w: np.stack(p) for w, p in planes.items()}
    top = max(pending, default=-1)
    while weight <= top or weight in pending:
        own = pending.pop(weight, None)
        while own is not None and len(own) > 1:
            m = len(own) // 3
            if m:
                a, b, c = own[:m], own[m : 2 * m], own[2 * m : 3 * m]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
                own = np.concatenate((total, own[3 * m :]))
            else:
                total, carry = own[:1] ^ own[1:], own[:1] & own[1:]
                own = total
            pending[weight + 1] = np.concatenate((pending[weight + 1], carry)) if weight + 1 in pending else carry
        out.append(own[0] if own is not None else None)
        weight += 1
    return out


class BlockIndex:
    """Bit slices of a block of integer vectors."""

    def __init__(self, values: np.ndarray, slices: int = SLICES) -> None:
        self.values = values
        n = len(values)
        self.words = -(-n // 64)
        low = values.min(axis=0)
        above = (values - low).astype(np.int64)
        width = int(above.max()).bit_length()
        self.shift = max(0, width - slices)
        digits = above >> self.shift
        rest = (above - (digits << self.shift)) - ((1 << self.shift) - 1) / 2
        self.rest = float(np.sqrt((rest**2).sum(axis=1)).max())
        self.spread = float(np.sqrt(((above - above.mean(axis=0)) ** 2).sum(axis=1)).max())
        self.bits = min(width, slices)
        self.slices = np.zeros((values.shape[1], self.bits, self.words), np.uint64)
        for i in range(self.bits):
            raw = np.zeros((values.shape[1], self.words * 8), np.uint8)
            packed = np.packbits((digits >> i).T & 1, axis=1, bitorder="little").astype(np.uint8)
            raw[:, : packed.shape[1]] = packed
            self.slices[:, i] = raw.view(np.uint64)
        self.all = self._bitmap(np.ones(n, bool))

    def _bitmap(self, mask: np.ndarray) -> np.ndarray:
        raw = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(mask, bitorder="little")
        raw[: len(packed)] = packed
        return raw.view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Digit bitmaps of the approximate score, up to a constant of the query, and how far it may be off, in its own unit."""
        drop = max(0, int(np.abs(query).max()).bit_length() + 1 - QUERY_BITS)
        factor = np.rint(query / (1 << drop)).astype(np.int64)
        left = query - (factor << drop)
        planes: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(factor).tolist():
            own = self.slices[d] if factor[d] > 0 else ~self.slices[d]  # -x = ~x and a constant
            k, j = abs(int(factor[d])), 0
            while k:
                if k & 1:
                    for i in range(self.bits):
                        planes.setdefault(i + j, []).append(own[i])
                k, j = k >> 1, j + 1
        unit = 1 << (drop + self.shift)
        off = float(np.linalg.norm(factor.astype(float) * (1 << drop))) * self.rest + float(np.linalg.norm(left.astype(float))) * self.spread
        empty = np.zeros(self.words, np.uint64)
        return [empty if p is None else p for p in carry_save(planes)], off / unit

    def candidates(self, query: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
        """Rows of valid that can be among the k best."""
        digits, off = self.scores(query)
        if int(np.bitwise_count(valid).sum()) <= k:
            chosen = valid
        else:
            sure, equal, least = 0, valid, 0
            for w in range(len(digits) - 1, -1, -1):
                high = equal & digits[w]
                count = int(np.bitwise_count(high).sum())
                if sure + count >= k:
                    equal, least = high, least | 1 << w
                else:
                    sure, equal = sure + count, equal & ~digits[w]
            bound = max(0, least - int(np.ceil(2 * off + 1e-6)))
            above, equal = np.zeros_like(valid), valid
            for w in range(len(digits) - 1, -1, -1):
                if bound >> w & 1:
                    equal = equal & digits[w]
                else:
                    above, equal = above | (equal & digits[w]), equal & ~digits[w]
            chosen = above | equal
        return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[: len(self.values)])


MOST_SCORE = 2.0**62  #: bound of scores that are added up in 64 bits


def _largest(column: pa.ChunkedArray) -> float:
    return float(np.abs(column.combine_chunks().flatten().to_numpy(zero_copy_only=False)).max(initial=0.0))


def _matrix(column: pa.ChunkedArray, dims: int, large: bool = False) -> np.ndarray:
    """floor(256 x) of each component, short vectors filled with 0; large: as Python integers."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if large:
        numbers = np.empty(len(flat), object)
        numbers[:] = [p * 256 // q for p, q in map(float.as_integer_ratio, flat.tolist())]
        flat = numbers
    else:
        flat = np.floor(_SCALE * flat).astype(np.int64)
    sizes = lists.value_lengths().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


_CELL = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _cell(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return _CELL.empty_table()
        dims = max(int(t.column("v").combine_chunks().value_lengths().to_numpy().max()) for t in (candidates, queries))
        large = dims * math.prod(_SCALE * _largest(t.column("v")) + 1 for t in (candidates, queries)) >= MOST_SCORE
        values = _matrix(candidates.column("v"), dims, large)
        index = None if large else BlockIndex(values)
        ids = candidates.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        order = np.argsort(ids, kind="stable")
        ranked = ids[order]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for q, key, vector in zip(queries.column("vec_id").to_pylist(), queries.column("query_key").to_pylist(), _matrix(queries.column("v"), dims, large), strict=True):
            own = order[np.searchsorted(ranked, q) : np.searchsorted(ranked, q, side="right")]
            if large:
                rows = np.setdiff1d(np.arange(len(ids)), own)
                exact = values[rows] @ vector
                best = np.array(sorted(range(len(rows)), key=lambda i: (-exact[i], ids[rows[i]]))[:k], np.int64)
                exact = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)
            else:
                valid = index.all
                if len(own):
                    valid = valid.copy()
                    np.bitwise_and.at(valid, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
                rows = index.candidates(vector, valid, k)
                exact = values[rows] @ vector
                best = np.lexsort((ids[rows], -exact))[:k]
            for o, x in zip(out, (np.full(len(best), q), np.full(len(best), key), ids[rows][best], exact[best]), strict=True):
                o.append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate(o), type=f.type) for o, f in zip(out, _CELL, strict=True)], schema=_CELL)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`."""
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v")).filter(fit)
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("query_key", F.xxhash64("v"))
    n, m = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    left = rows.withColumn("cell", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(query_blocks)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(_cell(k), "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = cells.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(int(np.iinfo(np.int64).max))).alias("vec_id"), "score")

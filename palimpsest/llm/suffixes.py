"""Exact repeated-substring removal: suffixes ordered only through their first 200 bytes, most significant digit first.

Every 200-byte window of every text is a depth-limited suffix, and equal groups after all digits are the repeats.
All suffixes cannot be shuffled, so two steps before the passes leave out what needs no ordering:

1. Prefilter. A window's anchor is the smallest hash among its 48-byte grams. Equal windows have equal anchors,
   and some 76 neighbouring windows share one anchor occurrence, so this costs one row for all of them. Windows
   under an anchor that occurs once are unique and leave. A clash of hashes only lets more windows through.
2. Combining. A run is all windows of one anchor occurrence. Runs that agree in anchor and run hash (128 bits) are
   copies: they are decided, and one witness with their number stays where the anchor has other runs.

The windows of the witnesses are then sorted by most-significant-digit passes over their literal bytes: each pass
splits the groups by the next digit, and groups of one leave after it. Anchors with few different runs are passed over
in one task, 8 bytes a pass, where groups whose members all agree need no sorting. For anchors with more, the
windows are rows of their own and a pass is a count of (group, digit), 100 bytes a digit, combined before its shuffle and joined
back on keys that Spark may split when skewed; so no group is gathered, however common its passage.

Rows that repeat both doc_id and text are one text with a weight: all of their windows start elsewhere too, so they are
decided as a whole, one of them stands for all in the steps above, and spans meet rows only at the end.

Defined cases. Null or empty text and texts under the length: nothing removed. Repeated rows and doc_ids: each row
is reported, and copies of 200 bytes or more lose everything. Empty table: no rows. `remove_repeats` keeps other
columns; in it bytes cut from a character leave the rest of the text decoded with incomplete characters left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import U64, Batches, as_bytes, carried, checkpointed, mix, retexted, rows_to_batch, slices, texts_in

LENGTH, GRAM, CHUNK = 200, 48, 1 << 18
NO_ID = -(1 << 63)  #: stands for a null doc_id in joins
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_MASK = U64((1 << 20) - 1)


class _Hasher:
    """Polynomial hashes modulo 2^64 over random byte values, for all substrings of a chunk at once."""

    def __init__(self, size: int) -> None:
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
        inverse = pow(int(_BASE), -1, 1 << 64)
        self.power = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size, _BASE))))
        self.inverse = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size, U64(inverse)))))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


_hashers: dict[int, _Hasher] = {}


def _hasher(size: int) -> _Hasher:
    """One table of powers for each worker, as long as the largest chunk."""
    if size not in _hashers:
        _hashers.clear()
        _hashers[size] = _Hasher(size)
    return _hashers[size]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def chunks_of(at: np.ndarray, length: int, size: int = CHUNK):
    """(first row, last row + 1, first byte, last byte + 1): whole rows up to `size` bytes, longer rows in parts that overlap by length - 1."""
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        if at[last] - at[row] <= size:
            yield row, last, int(at[row]), int(at[last])
        else:
            for a in range(int(at[row]), int(at[last]) - length + 1, size):
                yield row, last, a, min(a + size + length - 1, int(at[last]))
        row = last


def runs_of(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first window, windows, anchor hash and run hash of each run of windows that share an anchor."""
    hasher, found = _hasher(CHUNK + length), []
    for first, last, a, b in chunks_of(at, length):
        x = raw[a:b]
        if len(x) < length:
            continue
        prefix = hasher.prefix(x)
        grams = mix((prefix[gram:] - prefix[:-gram]) * hasher.inverse[: len(x) - gram + 1])
        where = (sliding_min((grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _MASK).astype(np.int64)
        ends = np.minimum(at[first + 1 : last + 1], b) - a
        inside = np.arange(len(where)) + length <= np.repeat(ends, np.diff(np.concatenate(([0], ends))))[: len(where)]
        fresh = np.ones(len(where), bool)
        fresh[1:] = (where[1:] != where[:-1]) | ~inside[:-1]
        start = np.flatnonzero(fresh & inside)
        if not len(start):
            continue
        close = np.ones(len(where), bool)
        close[:-1] = (where[1:] != where[:-1]) | ~inside[1:]
        stop = np.flatnonzero(close & inside) + 1
        row = np.searchsorted(at, start + a, side="right") - 1
        found.append((row, start + a - at[row], stop - start, grams[where[start]].view(np.int64), hasher.spans(prefix, start, stop + length - 1).view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5


_RUNS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("anchor", pa.int64()), ("run", pa.int64()), ("weight", pa.int32())])
_RUNS_DDL = "doc_id long, text_key long, start long, windows long, anchor long, run long, weight int"


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each row; touching intervals join."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    far = end + row * (1 << 40)  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(far)
    new = np.ones(len(row), bool)
    new[1:] = start[1:] + row[1:] * (1 << 40) > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first], start[first], reach[last] - row[first] * (1 << 40)


def _runs(batches: Batches) -> Batches:
    """Runs of a batch. Run values that repeat within it are decided here: one witness of weight 2 goes on, and
    their windows leave as merged intervals of weight 0, so hot passages and periodic texts shrink before the shuffle."""
    for b in slices(batches):
        row, start, windows, anchor, run = runs_of(*as_bytes(b.column("text")))
        order = np.lexsort((run, anchor))
        same = (anchor[order[1:]] == anchor[order[:-1]]) & (run[order[1:]] == run[order[:-1]])
        head = np.ones(len(order), bool)
        head[1:] = ~same
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        keep, local = order[head], order[twice]
        weight = np.where(twice[head] | (b.column("copies").to_numpy()[row[keep]] > 1), 2, 1).astype(np.int32)
        r, s, e = merged(row[local], start[local], start[local] + windows[local])
        ids, keys = b.column("doc_id"), b.column("text_key").to_numpy(zero_copy_only=False)
        nothing = np.zeros(len(r), np.int64)
        yield rows_to_batch(_RUNS, [
            ids.take(pa.array(np.concatenate((row[keep], r)))), keys[np.concatenate((row[keep], r))], np.concatenate((start[keep], s)), np.concatenate((windows[keep], e - s)),
            np.concatenate((anchor[keep], nothing)), np.concatenate((run[keep], nothing)), np.concatenate((weight, nothing.astype(np.int32))),
        ])


_CONTEXTS = pa.schema([("anchor", pa.int64()), ("weight", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("context", pa.binary())])


def _contexts(batches: Batches) -> Batches:
    """The bytes of each asked run."""
    for b in slices(batches):
        rows = []
        for i, k, text, asked in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "asked")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(x["anchor"], x["weight"], i, k, x["start"], raw[x["start"] : x["start"] + x["windows"] + LENGTH - 1]) for x in asked]
        yield rows_to_batch(_CONTEXTS, [list(c) for c in zip(*rows, strict=True)] or [[]] * 6)


DIGIT, ROW_DIGIT, GROUP_LIMIT = 8, 100, 2000  #: bytes of a digit in a task and between tasks; different runs of an anchor in a task


def repeated_windows(raw: np.ndarray, at: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places in `at` of the windows raw[at : at + length] that their group holds with a weight of two or more.

    Most-significant-digit passes over literal bytes; raw has a digit's bytes beyond the last window.
    """
    digits = np.ndarray((len(raw) - DIGIT + 1,), ">u8", raw, strides=(1,))
    live = np.argsort(group, kind="stable")
    group = group[live]
    for d in range(0, length, DIGIT):
        if not len(live):
            break
        digit = digits[at[live] + min(d, length - DIGIT)].astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((first, [len(live)])))
        mixed = np.logical_or.reduceat(digit != np.repeat(digit[first], sizes), first)
        if mixed.any():
            own = np.flatnonzero(np.repeat(mixed, sizes))
            order = own[np.lexsort((digit[own], group[own]))]
            live[own], digit[own] = live[order], digit[order]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
            first, group = np.flatnonzero(new), np.cumsum(new)
            sizes = np.diff(np.concatenate((first, [len(live)])))
        stay = np.repeat(np.add.reduceat(weight[live], first) >= 2, sizes)
        live, group = live[stay], group[stay]
    return live


def _windows_of(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the contexts end to end, and the context number and the place in it of every window."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join([*contexts, bytes(DIGIT)]), np.uint8), owner, place


_SPANS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])
_SPANS_DDL = "doc_id long, text_key long, start long, windows long"


def _same_windows(batches: Batches) -> Batches:
    """Over contexts sorted by anchor: the intervals of windows that their anchor's contexts hold twice."""

    def decide(t: pa.Table) -> pa.RecordBatch:
        contexts = t.column("context").to_pylist()
        raw, owner, place = _windows_of(contexts)
        anchor, weight, start = (t.column(c).to_numpy() for c in ("anchor", "weight", "start"))
        begin = np.cumsum([0, *map(len, contexts)])[:-1]
        at = repeated_windows(raw, begin[owner] + place, np.unique(anchor, return_inverse=True)[1][owner], weight[owner])
        r, s, e = merged(owner[at], start[owner[at]] + place[at], start[owner[at]] + place[at] + 1)
        rows = t.take(pa.array(r))
        return rows_to_batch(_SPANS, [rows.column("doc_id").combine_chunks(), rows.column("text_key").combine_chunks(), s, e - s])

    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        anchor = b.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut or (waiting and waiting[-1].column("anchor")[-1].as_py() != anchor[-1]):
            yield decide(pa.Table.from_batches([*waiting, b.slice(0, cut)]))
            waiting = []
        waiting.append(b.slice(cut))
    if waiting:
        yield decide(pa.Table.from_batches(waiting))


def _passes(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, start, windows) of the windows that their anchor's contexts hold twice: a window is a row, a pass a count and a join.

    The next group of a window is named by its least window, so that a pass is one job and its counts are written nowhere.
    """
    contexts = checkpointed(contexts.withColumn("context_id", F.monotonically_increasing_id()))
    window = F.col("context_id") * length + F.col("at")  # a context is one run, so it has fewer windows than `length`
    live = contexts.select("context_id", "context", "weight", F.col("anchor").alias("group"), F.explode(F.sequence(F.lit(0), F.length("context") - length)).alias("at"))
    for d in range(0, length, ROW_DIGIT):
        rows = live if d == 0 else live.join(contexts.select("context_id", "context"), "context_id")
        rows = rows.select("context_id", "weight", "group", "at", F.substring(F.col("context"), F.col("at") + (d + 1), F.lit(min(ROW_DIGIT, length - d))).alias("digit"))
        groups = rows.groupBy("group", "digit").agg(F.sum("weight").alias("n"), F.min(window).alias("next")).filter("n >= 2").select("group", "digit", "next")
        live = checkpointed(rows.join(groups, ["group", "digit"]).select("context_id", "weight", F.col("next").alias("group"), "at"))
    # A context is one run, so it has few windows; neighbours among them become one interval.
    island = F.col("at") - F.row_number().over(Window.partitionBy("context_id").orderBy("at"))
    runs = live.withColumn("island", island).groupBy("context_id", "island").agg(F.min("at").alias("at"), F.count("*").alias("windows"))
    return runs.join(contexts, "context_id").select("doc_id", "text_key", (F.col("start") + F.col("at")).alias("start"), "windows")


def _keyed(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


_ROW = ["doc_id", "text_key"]
FEW = 50_000  #: repeated rows' keys that are broadcast


def _distinct(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows, one for all that agree in doc_id and text, with copies (1 or 2); the spans of those that do, if any. Only keys are counted."""
    check, size = F.xxhash64(F.lit(1), "text"), F.octet_length("text")
    counts = keyed.groupBy(*_ROW).agg(F.count("*").alias("n"), F.min(check).alias("low"), F.max(check).alias("high"), F.max(size).alias("size"))
    again = checkpointed(counts.filter("n > 1 and low = high").select(*_ROW, "size"))
    n = again.count()
    if not n:
        return keyed.withColumn("copies", F.lit(1)), None
    keys = F.broadcast(again.select(*_ROW)) if n <= FEW else again.select(*_ROW)
    alone = keyed.join(keys, _ROW, "left_anti").withColumn("copies", F.lit(1))
    one = keyed.join(keys, _ROW, "left_semi").dropDuplicates(_ROW).withColumn("copies", F.lit(2))
    whole = again.filter(F.col("size") >= LENGTH).select(*_ROW, F.lit(0).cast("long").alias("start"), (F.col("size") - LENGTH + 1).cast("long").alias("windows"))
    return alone.unionByName(one), whole


def repeated_spans(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, text) of the rows, and (doc_id, text_key, start, windows): all windows that start anywhere else too.

    Anchors with up to group_limit different runs are passed over within a task, larger ones with a row per window.
    """
    rows = _keyed(docs, F.coalesce(docs["text"], F.lit("")))
    keyed, whole = _distinct(rows)
    # Runs are made twice, as a copy of them would take more room than the texts. Their parts of weight 0 are decided already and dealt by themselves.
    runs = keyed.filter(F.octet_length("text") >= LENGTH).mapInArrow(_runs, _RUNS_DDL)
    runs = runs.withColumn("anchor", F.when(F.col("weight") == 0, F.xxhash64("doc_id", "start")).otherwise(F.col("anchor")))
    # Counts combine before each shuffle, and what is joined back may be split on skewed keys: no anchor is gathered.
    anchors = runs.filter("weight > 0").groupBy("anchor").agg(F.sum("weight").alias("n")).filter("n >= 2").select("anchor", F.lit(True).alias("shared"))
    every = checkpointed(runs.join(anchors, "anchor", "left").filter("shared or weight = 0").drop("shared"))
    left = every.filter("weight > 0")
    values = checkpointed(left.groupBy("anchor", "run").agg(F.sum("weight").alias("total"), F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("witness")))
    copied = left.join(values.filter("total >= 2").select("anchor", "run"), ["anchor", "run"])
    decided = every.filter("weight = 0").unionByName(copied).select("doc_id", "text_key", "start", "windows")
    different = values.groupBy("anchor").agg(F.count("*").alias("n_values")).filter("n_values > 1")
    weight = F.least("total", F.lit(2)).cast("int").alias("weight")
    asked = checkpointed(values.join(different, "anchor").select("witness.doc_id", "witness.text_key", "n_values", F.struct("anchor", weight, "witness.start", "witness.windows").alias("ask")))

    def contexts(which: str) -> DataFrame:
        own = asked.filter(which).groupBy("doc_id", "text_key").agg(F.collect_list("ask").alias("asked"))  # at most a document's own runs
        return keyed.join(own, ["doc_id", "text_key"]).mapInArrow(_contexts, "anchor long, weight int, doc_id long, text_key long, start long, context binary")

    near = contexts(f"n_values <= {group_limit}").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_same_windows, _SPANS_DDL)
    spans = decided.unionByName(near)
    if asked.filter(f"n_values > {group_limit}").limit(1).count():
        spans = spans.unionByName(_passes(contexts(f"n_values > {group_limit}")))
    return rows, spans if whole is None else spans.join(whole.select(*_ROW), _ROW, "left_anti").unionByName(whole)


def _kept(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """Bytes outside the spans, and the number of maximal runs removed."""
    if not spans:
        return raw, 0
    start = np.array([s["start"] for s in spans], np.int64)
    end = start + np.array([s["windows"] for s in spans], np.int64) + LENGTH - 1
    _, a, b = merged(np.zeros(len(start), np.int64), start, end)
    return b"".join(raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)), len(a)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _report(batches: Batches) -> Batches:
    for b in slices(batches):
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            kept, n = _kept(raw, spans)
            out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        yield rows_to_batch(_REPORT, [b.column("doc_id"), *([x[i] for x in out] for i in range(4))])


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def repeat_report(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of docs."""
    keyed, spans = repeated_spans(docs, group_limit)
    found = _by_document(spans)
    return keyed.join(found, ["doc_id", "text_key"], "left").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def remove_repeats(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """docs with the repeated bytes cut from every text, other columns kept and n_chars (where it is a column) made to fit."""
    _, spans = repeated_spans(docs, group_limit)
    keyed = carried(docs).withColumns({"doc_id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)), "text_key": F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))})

    def cut(batches: Batches) -> Batches:
        for b in slices(batches):
            own = zip(texts_in(b).to_pylist(), b.column("spans").to_pylist(), strict=True)
            yield retexted(b, [_kept(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") if s else t for t, s in own])

    return keyed.join(_by_document(spans), ["doc_id", "text_key"], "left").select("row", "spans").mapInArrow(cut, docs.schema)

"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly; law `bytes`.

Groups (rows of equal text) are the items; each is a vector (bytes, tokens, rows). Level 1: groups are dealt to
buckets by hash, and in each bucket every group goes, largest first, to the local bin whose residual capacity has the
highest dot product with the group's vector. Level 2 places, by the same rule: the local bins of all buckets (32 a bucket
up to 2048 buckets, fewer beyond, at most 65,536), groups of over half a shard, and a share of single groups set aside by hash (an eighth of them, and no more
than about 2000), which come late as they are small. Last, small items are moved or exchanged between two shards
for as long as that lessens their weighted squares of residual capacity. Level 1 runs in parallel; only bin totals and the
groups set aside come to the driver.

A group over a shard's capacity in any dimension cannot keep the law; it is split by row key into parts of
about an eighth of a shard. All other groups stay whole.

Defined cases. Null or empty text: size 1, crc32 0; all such rows are one group. Repeated rows: rows of one group.
Empty table: no rows. slot numbers a shard's rows from 0 without gaps, by prefix sums over salted parts of the
shard. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed

SHARDS = 8
LOCAL_BINS, MOST_BINS, GROUPS_PER_BUCKET, MAX_BUCKETS, ASIDE_SHARE, ASIDE_MOST, ROWS_PER_SALT = 32, 65_536, 500, 8192, 8, 2000, 50_000
_DIMENSIONS = ["bytes", "tokens", "rows"]
_WEIGHTS = np.array([4.0, 1.0, 1.0])  #: in the dot product; the law is on bytes


def place(items: np.ndarray, capacity: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item, largest first, where the dot product of item and residual capacity is highest; ties to the lower bin."""
    vectors = items / np.where(capacity > 0, capacity, 1.0)
    weighted = vectors * _WEIGHTS
    residual = np.ones((bins, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -weighted.sum(axis=1))).tolist():
        k = int(np.argmax(residual @ weighted[i]))
        residual[k] -= vectors[i]
        out[i] = k
    return out


def levelled(items: np.ndarray, placed: np.ndarray, capacity: np.ndarray, bins: int, rounds: int = 2000, smallest: int = 256) -> np.ndarray:
    """placed after moves and exchanges of the `smallest` items of two bins, the fullest first, that lessen the weighted squares of residuals."""
    vectors = np.concatenate((items / np.where(capacity > 0, capacity, 1.0), np.zeros((1, items.shape[1]))))  # last: no item, for moves
    placed, none = placed.copy(), len(items)
    weight = vectors @ _WEIGHTS
    used = np.stack([vectors[:none][placed == k].sum(axis=0) for k in range(bins)]) * _WEIGHTS**0.5
    scaled = vectors * _WEIGHTS**0.5
    small = [[*sorted(np.flatnonzero(placed == k).tolist(), key=weight.__getitem__)[:smallest], none] for k in range(bins)]
    for _ in range(rounds):
        order = np.argsort(-used.sum(axis=1), kind="stable").tolist()
        for a, b in sorted(((order[i], order[j]) for i in range(bins) for j in range(i + 1, bins)), key=lambda x: -float(((used[x[0]] - used[x[1]]) ** 2).sum())):
            gap = used[a] - used[b]
            x, y = scaled[small[a]], scaled[small[b]]
            moved = x[:, None] - y[None]
            gain = moved @ gap - (moved**2).sum(axis=2)
            i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[i, j] > 1e-12:
                p, q = small[a][i], small[b][j]
                used[a] -= moved[i, j]
                used[b] += moved[i, j]
                for item, now, then in ((p, a, b), (q, b, a)):
                    if item != none:
                        placed[item] = then
                        small[now].remove(item)
                        small[then].append(item)
                break
        else:
            break
    return placed


def _local_bins(bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "text_key", "text_crc32"], ascending=[False, True, True], kind="stable")
        items = pdf[_DIMENSIONS].to_numpy(float)
        pdf["bin"] = pdf["bucket"] * bins + place(items, items.sum(axis=0) / bins, bins)
        return pdf[["text_key", "text_crc32", "bytes", "tokens", "rows", "bin"]]

    return run


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    rows = checkpointed(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"), F.monotonically_increasing_id().alias("row_key"),
        )
    )
    groups = rows.groupBy("text_key", "text_crc32").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _DIMENSIONS), F.count("*").alias("groups")).first()
    capacity = np.array([float(total[c]) / shards for c in _DIMENSIONS])
    ratio = F.greatest(*(F.col(c) / max(x, 1.0) for c, x in zip(_DIMENSIONS, capacity, strict=True)))
    # Groups over half a shard: fewer than 2 x shards in each dimension, so at most 48 rows.
    wide = groups.filter(ratio > 0.5).select("text_key", "text_crc32", F.when(ratio > 1, F.ceil(8 * ratio)).otherwise(1).cast("long").alias("parts"))
    wide = spark.createDataFrame(wide.collect(), "text_key long, text_crc32 long, parts long")
    parted = rows.join(F.broadcast(wide), ["text_key", "text_crc32"]).withColumn("part", F.pmod(F.xxhash64("row_key"), F.col("parts")))
    part_totals = parted.groupBy("text_key", "text_crc32", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).toPandas()
    buckets = int(np.clip(total["groups"] // GROUPS_PER_BUCKET, 1, MAX_BUCKETS))
    aside = F.pmod(F.xxhash64("text_key", "text_crc32"), F.lit(max(ASIDE_SHARE, int(total["groups"]) // ASIDE_MOST))) == 0
    narrow = groups.filter(ratio <= 0.5)
    singles = narrow.filter(aside).toPandas()  # about ASIDE_MOST rows at most
    bins = checkpointed(narrow.filter(~aside).withColumn("bucket", F.pmod("text_key", F.lit(buckets))).groupBy("bucket").applyInPandas(_local_bins(min(LOCAL_BINS, MOST_BINS // buckets)), "text_key long, text_crc32 long, bytes long, tokens long, rows long, bin long"))
    bin_totals = bins.groupBy("bin").agg(*(F.sum(c).alias(c) for c in _DIMENSIONS)).toPandas()  # at most MOST_BINS rows
    items = np.concatenate([x[_DIMENSIONS].to_numpy(float) for x in (part_totals, bin_totals, singles)])
    placed = levelled(items, place(items, capacity, shards), capacity, shards).tolist()
    n, m = len(part_totals), len(part_totals) + len(bin_totals)
    local = lambda pdf, names, own, ddl: spark.createDataFrame([(*map(int, r), s) for r, s in zip(pdf[names].itertuples(index=False), own, strict=True)], ddl)
    of_part = local(part_totals, ["text_key", "text_crc32", "part"], placed[:n], "text_key long, text_crc32 long, part long, shard int")
    of_bin = local(bin_totals, ["bin"], placed[n:m], "bin long, shard int")
    of_single = local(singles, ["text_key", "text_crc32"], placed[m:], "text_key long, text_crc32 long, shard int")
    names = ["doc_id", "size", "text_crc32", "row_key", "shard"]
    assigned = bins.join(F.broadcast(of_bin), "bin").select("text_key", "text_crc32", "shard").unionByName(of_single)
    dealt = rows.join(assigned, ["text_key", "text_crc32"]).select(*names).unionByName(parted.join(F.broadcast(of_part), ["text_key", "text_crc32", "part"]).select(*names))
    salts = max(1, int(total["rows"]) // ROWS_PER_SALT // shards)
    dealt = checkpointed(dealt.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("shard", "salt").agg(F.count("*").alias("n")).select("shard", "salt", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("row_key")) - 1
    return dealt.withColumn("rank", rank).join(offsets, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

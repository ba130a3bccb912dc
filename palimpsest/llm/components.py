"""Connected components with DataFrame operations only: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed


def _pairs(*pairs: tuple[Column | str, Column | str], names: tuple[str, str] = ("src", "dst")) -> Column:
    """A row for each of the pairs: one pass where a union would read its input once a branch."""
    own = lambda c: F.col(c) if isinstance(c, str) else c
    return F.inline(F.array(*(F.struct(own(a).alias(names[0]), own(b).alias(names[1])) for a, b in pairs)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours; a row for each edge, links that repeat included."""
    both = edges.select(_pairs(("src", "dst"), ("dst", "src")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("root"))
    return down.join(least, "src").select(_pairs(("dst", "root"), ("src", "root"))).filter("src <> dst").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges to smaller nodes, or edges to smaller and to larger ones; edges are distinct, each from the larger node."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))))
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not counts.agg(F.coalesce(F.max(F.col("down") + F.col("up")), F.lit(0)).alias("most")).first()["most"] > 1


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node with an edge; component is the smallest node reachable.

    edges has columns src and dst of one orderable type; null ends and loops are left out. A round's minima
    combine before their shuffle and joins may be split on skewed keys, so a hub's group is never gathered.
    Each round is checkpointed to the shared folder. Rounds grow with the logarithm of the nodes, and end when
    every node but the smallest of its component has one edge, to that one; no round is spent to see that nothing changes.
    """
    known = edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst")
    now = checkpointed(known.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        now = checkpointed(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(_pairs(("src", "dst"), ("dst", "dst"), names=("node", "component"))).groupBy("node").agg(F.min("component").alias("component"))

"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a min-aggregation and a join by node; hot nodes (star centres)
are summed map-side, and the join's skewed partitions can be split.  Rounds are
checkpointed in the shared folder.  The number of rounds grows with the log of
the longest chain, not with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have an edge; edges: a, b (long); component: the least node reachable."""
    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        now = _state(e)
        if now == before or not now[0]:
            break
        before = now
        # large star: each larger neighbour of a node goes to the least of its neighbourhood
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components: not settled after {ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Nulls at either end drop the edge; self loops only add their node; repeated edges count once.  The
component is the smallest node id in it.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected_components(edges: DataFrame, src: str, dst: str, rounds: int = 40) -> DataFrame:
    """(node, component).  Each round is one shuffle per star; the number of rounds grows with the logarithm of the longest path."""
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    pairs = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, "cc")
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(after, "cc")
        changed = after.exceptAll(pairs).isEmpty() and pairs.exceptAll(after).isEmpty()
        pairs = after
        if changed:
            break
    else:
        raise RuntimeError("components did not settle")
    root = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("component", "node").alias("component"))

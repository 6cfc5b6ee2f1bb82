"""Connected components as joins and aggregates (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: Up to this many (node, minimum) rows are broadcast: about 2 MB, as every round sends some.
BROADCAST_NODES = 20_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, root)``: each node with an edge
    to another node, and the smallest node that it reaches.

    Self loops, repeated edges and nulls on either end give nothing. Each round
    is a minimum per node (combined before the shuffle) joined back to the edges, so a hub
    is never gathered: the minimum of a hub is one row, and the join may be
    split. Rounds are checkpointed; their number grows with the logarithm of
    the longest path.
    """
    e = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    over = F.col("u") > F.col("v")
    e = cut(e.select(F.when(over, F.col("u")).otherwise(F.col("v")).alias("u"),
                     F.when(over, F.col("v")).otherwise(F.col("u")).alias("v")).distinct())
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = small(cut(low.select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))), BROADCAST_NODES)
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = small(cut(large.groupBy("u").agg(F.min("v").alias("m"))), BROADCAST_NODES)
        kept = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


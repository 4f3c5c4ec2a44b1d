"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checkpoint, join_sized

#: Edges that are few enough for one task; no step of theirs needs a shuffle.
FEW = 100_000


def turned(df: DataFrame, *edges: tuple[Column, Column]) -> DataFrame:
    """(u, v) for each of the edges of every row."""
    both = F.array(*(F.struct(u.alias("u"), v.alias("v")) for u, v in edges))
    return df.select(F.explode(both).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edges (a, b) other than its component's smallest, that smallest node.

    Every step joins and aggregates by key; edges stay distributed, and a node with very many neighbours is broadcast to them. The number
    of steps grows with the logarithm of the longest chain.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    pairs = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    few = pairs.limit(FEW + 1).count() <= FEW
    if few:
        pairs = checkpoint(pairs.coalesce(1))
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == seen or not state[0]:
            return pairs.select(u.alias("node"), v.alias("component"))
        seen = state
        both = turned(pairs, (u, v), (v, u))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        met = both.join(least, "u") if few else join_sized(both, checkpoint(least), ["u"], "size")
        large = met.filter("v > u").select(v.alias("u"), m.alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = checkpoint(turned(large.join(lower, "u"), (v, m), (u, m)).filter("u <> v").distinct())

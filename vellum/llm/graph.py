"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import checkpointed


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for links(a long, b long); a component is named by its smallest node.

    Alternating large and small stars.  A star is a minimum by node joined back to the
    links: no neighbour list is ever collected, a hub's links stay spread (the
    minimum is pre-aggregated and the join's hot key is split by adaptive execution).
    Each round is checkpointed; rounds grow with the logarithm of the longest path.
    Nodes without links do not appear; loops and repeated links are harmless.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs(u, v), u > v, to links of the larger or the smaller neighbours with the least of all."""
        if large:
            both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = pairs
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        moved = both.join(least, both["u"] == least["k"]).select("u", "v", "m")
        if large:
            out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return out.where(F.col("u") > F.col("v")).distinct()

    pairs = checkpointed(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(pairs)
    for _ in range(rounds):
        if not before[0]:
            break
        pairs = checkpointed(star(star(pairs, True), False))
        now = state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # settled: every node hangs directly below its component's smallest node
    named = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

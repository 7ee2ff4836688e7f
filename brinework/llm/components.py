"""Connected components over a links table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (all, then those above it, or only smaller ones) hang on the smallest of them and itself."""
    if large:
        pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written before the join, so that Spark can split a node with very many neighbours between tasks
    least = checkpointed(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    hung = pairs.join(least, "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of links (u, v); root is the smallest node of its component.

    Nulls, self links and repeated links are dropped; an empty table gives an empty table. Rounds grow with the
    logarithm of a component's size, and each is a group-by with partial minima and a join that Spark can split.
    """
    edges = links.select("u", "v").where(F.col("u") != F.col("v")).distinct()
    edges = checkpointed(edges)
    state = None
    for _ in range(max_rounds):
        edges = checkpointed(_star(_star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).collect()[0]
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table, by alternating large-star and small-star.

Both steps only take a minimum per node and join it back, so a hub with a third
of all edges is pre-aggregated and its join is split by adaptive execution; no
neighbourhood is collected. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm.scratch import Scratch, join_back


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (a, b) with a > b. Neighbours above (large) or below (small) a node move to its least neighbour."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = join_back(both, least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): every node with an edge, and the least node that it reaches. ``edges``: (a, b) longs, in any order."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    current = nxt = scratch.table(edges, f"{name}-0")
    seen, turn, any_edge = None, 0, current.limit(1).count()
    while any_edge:
        turn += 1
        nxt = scratch.table(_star(_star(current, True), False), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        # A fixed point is a forest of stars; sums of hashes stand for the set of edges.
        state = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, current = state, nxt
    return nxt.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(nxt.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

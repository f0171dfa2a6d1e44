"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import kept

MOST_ROUNDS = 60
EDGES_A_TASK = 50_000  # so that a small graph isn't spread over thousands of files in every round


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``, two bigint columns; the component is its least node.

    Large star hangs each node's greater neighbours on the least node around it,
    small star its lesser ones. Both are a map-side combined minimum and a join
    with one row per node on one side, so a node with very many edges is split.
    Only a count and a sum of edge hashes reach the driver.
    """
    state = kept(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
        tasks = math.ceil(now["n"] / EDGES_A_TASK)
        state = kept(_small_star(_large_star(state, tasks), tasks).coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    # a settled state is one star per component: (member, least)
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a"), F.least("a", "_m").alias("_m"))
    joined = both.join(least, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """``edges`` point from the greater to the lesser node."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    joined = edges.join(least, "a")
    moved = joined.where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).coalesce(tasks).distinct()

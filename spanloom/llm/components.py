"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of its neighbourhood."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them. Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for each node of an edge, component being the least node reachable.

    edges: columns a and b, of one comparable type; order, repeats and loops don't matter, nulls link nothing. A hub
    is never gathered: each step is a minimum (combined before the shuffle) and a join that Spark can split where it
    is skewed. Every step is written to the shared folder, so nothing is computed twice or lost with an executor.
    No edges: no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen, turn = scratch.put(edges, f"{name}-0"), None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, turn = state, turn + 1
        big = _large_star(edges).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = scratch.put(_small_star(big).where("a <> b").distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        edges = after

"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.tables import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node points to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    pairs = edges.join(least, "b")
    moved = pairs.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of each node in ``links (a, b)`` with a < b; the root is the smallest node.

    Each round is a written table, so a lost executor costs one round at most.
    """
    edges, before = stage(links.select("a", "b").distinct(), "links"), None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state := (sums["n"], sums["x"])) == before or not sums["n"]:
            break
        before = state
        edges = stage(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

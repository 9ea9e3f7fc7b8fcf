"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import few, frozen


def _large_star(edges: DataFrame, sized) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return sized(both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("m").alias("a"), F.col("v").alias("b"))).distinct()


def _small_star(edges: DataFrame, sized) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = (edges.join(least, "b").where("a <> m")
             .select(F.col("m").alias("a"), F.col("a").alias("b")))
    return sized(moved.unionByName(least.select(F.col("m").alias("a"), "b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60, merged: bool = False) -> DataFrame:
    """(node, root): root is the least node reachable, for nodes that have an edge.

    ``edges`` has columns ``a < b`` of one comparable type.  Each round is two
    group-by-min joins on the edge table; the edges themselves never reach the
    driver, only their count and a sum of their hashes, which tell when the
    stars no longer change.  ``merged`` keeps each round's tables in as many
    partitions as their counted rows are worth.
    """
    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = frozen(edges.select("a", "b").where("a < b").distinct())
    before = print_of(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # a large star keeps the number of edges at most, a small star at most doubles it
        sized = (lambda df, rows=2 * before[0]: few(df, rows)) if merged else (lambda df: df)
        edges = frozen(sized(_small_star(sized(_large_star(sized(edges), sized)), sized)))
        now = print_of(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    edges = few(edges, before[0]) if merged else edges
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

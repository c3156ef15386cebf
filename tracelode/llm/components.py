"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b.

    Large: every neighbour above a node is hung on the least neighbour. Small:
    every neighbour below it. The least neighbour is an aggregate with map-side
    combining, joined back; no neighbour list is ever built.
    """
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        hung = around.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a > b").distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node reachable.

    Nodes are longs. Self links and repeated or reversed links change nothing;
    an empty table gives an empty result. Each round is written to the shared
    folder, so lineage stays one round deep.
    """
    now = stash(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    for _ in range(rounds):
        before, now = now, stash(_star(_star(now, True), False), "stars")
        forget(before)
        was, mark = mark, _mark(now)
        if mark == was:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")

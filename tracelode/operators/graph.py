"""Graphs of parent pointers: closures, validation, paths, re-linking.

Loops advance a whole frontier at a time as a join; each step is written to
the shared checkpoint folder, so plans stay short and survive lost executors.
Pointer doubling is used where only an end counts, so depth costs its logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def descendants(nodes: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, depth) of everything below the seeds, the seeds at depth 0; a cycle is walked once.

    nodes have id and parent; seeds have id.
    """
    edges = nodes.where("parent is not null and id is not null").select("parent", "id").distinct()
    front = found = cut_lineage(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        below = edges.join(front.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        front = cut_lineage(below.join(found, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
        if depth % 8 == 0:
            found = cut_lineage(found)
    raise RuntimeError(f"a closure goes deeper than {most} levels")


def doubled(edges: DataFrame, seeds: DataFrame, most: int = 30) -> DataFrame:
    """As descendants, for edges (parent, id) of a forest, read from either end.

    Each step reaches twice as far: what lies within 2^k edges, and what lies
    2^k edges beyond that. A way of n edges takes log n steps; where a node has
    many parents and many children the far edges would be too many, which
    descendants is for.
    """
    far = cut_lineage(edges.where("parent is not null and id is not null").select("parent", "id").distinct())
    found = cut_lineage(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    had = found.count()
    for step in range(most):
        beyond = far.join(found.select(F.col("id").alias("parent"), "depth"), "parent").select("id", (F.col("depth") + (1 << step)).alias("depth"))
        found = cut_lineage(found.unionByName(beyond).groupBy("id").agg(F.min("depth").alias("depth")))
        now = found.count()
        if now == had:
            return found
        had = now
        far = cut_lineage(far.withColumnRenamed("id", "mid").join(far.withColumnRenamed("parent", "mid"), "mid").select("parent", "id").distinct())
    raise RuntimeError(f"a way is longer than 2^{most} edges")


def ancestors(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, depth) of the seeds and everything above them."""
    return doubled(nodes.select(F.col("id").alias("parent"), F.col("parent").alias("id")), seeds)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is null").select("id")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.select("id").join(nodes.select(F.col("parent").alias("id")), "id", "left_anti")


def active_path(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Nodes from the root to the active one, with their distance from it."""
    return ancestors(nodes, active).join(nodes.select("id"), "id", "left_semi")


def on_cycles(nodes: DataFrame, most: int = 60) -> DataFrame:
    """Nodes whose way up never ends, by pointer doubling.

    Depths have no gaps, so once doubling the reach frees no node, none of the
    rest will ever be free.
    """
    up = cut_lineage(nodes.where("parent is not null").select("id", "parent").distinct())
    left = up.count()
    for _ in range(most):
        to = up.select(F.col("id").alias("parent"), F.col("parent").alias("far"))
        up = cut_lineage(up.join(to, "parent").select("id", F.col("far").alias("parent")).distinct())
        was, left = left, up.count()
        if left == was:
            break
    return up.select("id").distinct()


def problems(nodes: DataFrame) -> DataFrame:
    """(id, problem): empty or repeated ids, missing parents, cycles."""
    empty = nodes.where("id is null").select("id", F.lit("empty id").alias("problem"))
    twice = nodes.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    known = nodes.select(F.col("id").alias("parent")).distinct()
    missing = nodes.where("parent is not null").join(known, "parent", "left_anti").select("id", F.lit("missing parent").alias("problem"))
    cycle = on_cycles(nodes).withColumn("problem", F.lit("cycle"))
    return empty.unionByName(twice).unionByName(missing).unionByName(cycle)


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing and all below them."""
    known = nodes.select(F.col("id").alias("parent")).distinct()
    lost = nodes.where("parent is not null").join(known, "parent", "left_anti").select("id")
    return doubled(nodes, lost)


def ordered_tree(nodes: DataFrame, seeds: DataFrame, order: str, most: int = 200) -> DataFrame:
    """Everything below the seeds in depth-first order, children by ``order`` and then id: (id, depth, way)."""
    step = F.concat(F.lpad(F.col(order).cast("string"), 20, "0"), F.lit(":"), F.lpad(F.col("id").cast("string"), 20, "0"))
    kids = nodes.where("parent is not null").select("parent", "id", step.alias("step"))
    front = found = cut_lineage(nodes.join(seeds, "id", "left_semi").select("id", F.lit(0).alias("depth"), step.alias("way"), F.array("id").alias("seen")))
    for depth in range(1, most + 1):
        below = kids.join(front.select(F.col("id").alias("parent"), "way", "seen"), "parent").where(~F.array_contains("seen", F.col("id")))
        front = cut_lineage(below.select("id", F.lit(depth).alias("depth"), F.concat("way", F.lit("/"), "step").alias("way"), F.concat("seen", F.array("id")).alias("seen")))
        if front.isEmpty():
            return found.drop("seen")
        found = found.unionByName(front)
    raise RuntimeError(f"a tree goes deeper than {most} levels")


def relink(nodes: DataFrame, deleted: DataFrame, most: int = 60) -> DataFrame:
    """The nodes that stay, each with its nearest parent that stays too; pointers past deleted nodes double."""
    gone = deleted.select("id").distinct()
    skip = cut_lineage(nodes.join(gone, "id", "left_semi").select(F.col("id").alias("parent"), F.col("parent").alias("up")))
    for _ in range(most):
        more = skip.select(F.col("parent").alias("up"), F.col("up").alias("far"), F.lit(True).alias("hit"))
        after = cut_lineage(skip.join(more, "up", "left").select("parent", F.when(F.col("hit"), F.col("far")).otherwise(F.col("up")).alias("up"), F.coalesce("hit", F.lit(False)).alias("moved")))
        skip = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    kept = nodes.join(gone, "id", "left_anti")
    return kept.join(skip.withColumn("hit", F.lit(True)), "parent", "left").select("id", F.when(F.col("hit"), F.col("up")).otherwise(F.col("parent")).alias("parent"))


def pair_closure(links: DataFrame, seeds: DataFrame, most: int = 1_000) -> DataFrame:
    """Rows joined to the seeds through shared call ids, in either direction, to the end; links have row and call."""
    both = links.select("row", "call").distinct()
    found = cut_lineage(seeds.select("row").distinct())
    front = found
    for _ in range(most):
        calls = both.join(front, "row", "left_semi").select("call").distinct()
        front = cut_lineage(both.join(calls, "call", "left_semi").select("row").distinct().join(found, "row", "left_anti"))
        if front.isEmpty():
            return found
        found = cut_lineage(found.unionByName(front))
    raise RuntimeError(f"a closure takes more than {most} steps")


def exclusive(closure: DataFrame, kept: DataFrame) -> DataFrame:
    """What a deletion takes, without what something that stays also reaches."""
    return closure.join(kept, "id", "left_anti")

"""Approximate nearest neighbours over an inverted multi-index.

A vector's two halves are quantised apart, each to its own centroids, so K
centroids a half make K * K cells. A query walks the cells by the sum of the
two half distances, kept in a heap, until the cells passed hold enough entries,
and those entries are reranked by exact cosine.

Neighbouring small cells share a block and large cells are split over several,
so blocks have a bounded size. Blocks are dealt out over the cluster, and each
meets the queries that visit one of its cells as two matrices, a bounded part of
the queries at a time. What is returned from a block is at most k rows a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import stash

K = 5
CENTROIDS = 64
#: Different vectors that the centroids are fitted on, by the order of a hash.
SAMPLE = 16_384
#: A query passes cells until they hold this share of the different vectors.
SHARE = 0.5
#: Entries of a cell, and queries, that one task reranks together.
BLOCK = 4_096


def lloyd(points: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of the points: k of them, or as many as there are different points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centre = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(steps):
        near = squared(points, centre).argmin(axis=1)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, points)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centre.T + (centre**2).sum(axis=1)[None]


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> Iterator[tuple[int, int]]:
    """Cells by the sum of both half distances until those passed hold enough entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = sizes[a[i], b[j]]
        if n:
            held += n
            yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def deal(sizes: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """The first block and the number of blocks of each cell.

    A cell of more than ``most`` entries is split; smaller cells in a row share
    a block of at most so many.
    """
    first, parts, block, held = [], [], 0, 0
    for n in sizes.tolist():
        if held and held + n > most:
            block, held = block + 1, 0
        first.append(block)
        parts.append(max(1, -(-n // most)))
        held += n
        if parts[-1] > 1:
            block, held = block + parts[-1], 0
    return first, parts


def _unit(rows: pd.Series) -> np.ndarray:
    """Vectors of length 1; scaled first, so that neither huge nor tiny numbers overflow."""
    x = np.array(rows.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part, as doubles."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = K, centroids: int = CENTROIDS, share: float = SHARE, sample: int = SAMPLE, together: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query by cosine.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    other rows. Equal scores go to the smaller id. Vectors that are null, empty,
    zero or hold null or non-finite numbers take no part, nor do rows without
    an id or with another number of components than most; a repeated id counts
    with its least vector. Fewer candidates than k give fewer rows; an empty
    table gives an empty result. Other columns are not looked at.

    Equal vectors are one entry of the index, which holds the k + 1 least ids
    that have it: no more can ever be among the k nearest of a query. That is
    exact, and keeps a group of copies of any size from filling a cell.

    Queries are dealt into parts of about ``together`` by a hash of their ids,
    and a block is sent to each part, so that no task holds more queries than
    that however many visit a block.
    """
    rows = usable(vectors, id_col, vector_col)
    widths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width = widths[0]["n"]
    half = max(1, width // 2)
    rows = rows.where(F.size("vec") == width).groupBy("id").agg(F.min("vec").alias("vec"))
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("nth") <= k + 1)
    entries = stash(numbered.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    drawn = entries.orderBy(F.xxhash64("vec"), "vec").limit(sample).select("vec").toPandas()  # a fixed number of rows
    points = _unit(drawn["vec"])
    centre = (lloyd(points[:, :half], centroids), lloyd(points[:, half:], centroids) if width > 1 else np.zeros((1, 0)))

    def halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(unit[:, :half], centre[0]), squared(unit[:, half:], centre[1]) if width > 1 else np.zeros((len(unit), 1))

    @F.pandas_udf(T.IntegerType())
    def cell_of(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype="int32")
        first, second = halves(_unit(vecs))
        return pd.Series(first.argmin(axis=1) * len(centre[1]) + second.argmin(axis=1), dtype="int32")

    indexed = stash(entries.withColumn("cell", cell_of("vec")), "indexed")
    sizes = np.zeros((len(centre[0]), len(centre[1])), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        sizes.ravel()[r["cell"]] = r["count"]
    total = int(sizes.sum())
    enough = max(k + 2, int(share * total))
    first_block, parts = deal(sizes.ravel(), BLOCK)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                first, second = halves(_unit(some["query"]))
                rows = []
                for name, query, x, y in zip(some["query_id"], some["query"], first, second, strict=True):
                    cells: dict[int, list[int]] = {}
                    for i, j in walk(x, y, sizes, enough):
                        c = i * len(centre[1]) + j
                        for b in range(first_block[c], first_block[c] + parts[c]):
                            cells.setdefault(b, []).append(c)
                    rows += [(name, query, b, cs) for b, cs in cells.items()]
                yield pd.DataFrame(rows, columns=["query_id", "query", "block", "cells"])

    begin, split = np.array(first_block), np.array(parts)

    @F.pandas_udf(T.IntegerType())
    def block_of(cells: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(begin[cells.to_numpy()] + hashes.to_numpy() % split[cells.to_numpy()], dtype="int32")

    placed = indexed.select("vec", "ids", "cell", block_of("cell", F.xxhash64("vec")).alias("block"))
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    count = queries.count()
    groups = -(-count // together) or 1
    tasks = min(-(-count // 64) or 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # By a hash of the id: a repartition by the id itself is dropped where rows are already grouped by it.
    asked = queries.repartition(tasks, F.xxhash64("query_id")).mapInPandas(visit, "query_id long, query array<double>, block int, cells array<int>")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rerank(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(asking) and len(held):
            unit, ids, cell = _unit(held["vec"]), held["ids"].tolist(), held["cell"].to_numpy()
            for at in range(0, len(asking), 256):
                some = asking.iloc[at : at + 256]
                q = _unit(some["query"])
                near = q @ unit.T
                for row, cells in enumerate(some["cells"]):
                    near[row, ~np.isin(cell, cells)] = -np.inf
                # One entry more than k, for the query's own; all within rounding of the last are kept.
                kth = np.partition(near, -min(k + 1, near.shape[1]), axis=1)[:, -min(k + 1, near.shape[1])]
                for row, (name, bound) in enumerate(zip(some["query_id"], kth, strict=True)):
                    for e in np.flatnonzero((near[row] >= bound - 1e-12) & (near[row] > -np.inf)):
                        score = float((q[row] * unit[e]).sum())
                        for i in [i for i in ids[e] if i != name][:k]:
                            out["query_id"].append(name)
                            out["vec_id"].append(i)
                            out["score"].append(score)
        found = pd.DataFrame(out)
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k) if len(found) else found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asked.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

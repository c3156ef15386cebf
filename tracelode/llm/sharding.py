"""Balanced shards by multiway Karmarkar-Karp differencing, level by level.

Rows with equal texts are one indivisible group with a weight in bytes. A
partial partition has one part for each shard; two of them are combined by
adding the heaviest part of one to the lightest of the other, and so on. In a
bucket of groups the two of largest spread are combined until one is left. The
buckets' partial partitions are then the members of the next level's buckets,
until one bucket remains. Every level runs as tasks of bounded size, and what
a level keeps of a bucket is one number for each shard.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import documents, stash

SHARDS = 24
#: Groups in a bucket of the first level, and buckets in one of the next.
GROUPS, FAN = 8_192, 256
#: Rows that are numbered together, over all shards.
CHUNK = 2_048


def difference(members: list[list[int]]) -> list[list[int]]:
    """Where each part of each member goes: result[member][part] is its final part.

    Every member is a partial partition of equally many parts. Of equal
    spreads the earlier one is taken first.
    """
    parts = len(members[0])
    heap = []
    for k, sums in enumerate(members):
        node = sorted(((s, (k, p)) for p, s in enumerate(sums)), key=lambda x: -x[0])
        heap.append((node[-1][0] - node[0][0], k, node))
    heapq.heapify(heap)
    made = len(members)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        node = sorted(((x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (node[-1][0] - node[0][0], made, node))
        made += 1
    out = [[0] * parts for _ in members]
    for place, (_, tree) in enumerate(heap[0][2]):
        todo = [tree]
        while todo:
            x, y = todo.pop()
            if isinstance(x, tuple):
                todo += [x, y]
            else:
                out[x][y] = place
    return out


def _first_level(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "digest"], ascending=[False, True], ignore_index=True)
        found = difference([[w] + [0] * (shards - 1) for w in rows["weight"].tolist()])
        return rows.assign(part=[f[0] for f in found])[["digest", "weight", "bucket", "part"]]

    return run


def _next_level(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        buckets = sorted(rows["bucket"].unique().tolist())
        sums = {b: [0] * shards for b in buckets}
        for b, p, w in zip(rows["bucket"].tolist(), rows["part"].tolist(), rows["weight"].tolist(), strict=True):
            sums[b][p] = w
        found = difference([sums[b] for b in buckets])
        return pd.DataFrame([(b, p, b // FAN, to, sums[b][p]) for b, f in zip(buckets, found, strict=True) for p, to in enumerate(f)], columns=["bucket", "part", "above", "to", "weight"])

    return run


def group_shards(groups: DataFrame, shards: int = SHARDS, per_bucket: int = GROUPS) -> DataFrame:
    """(digest, shard) for groups (digest, weight): weights of the shards are near equal."""
    buckets = max(1, -(-groups.count() // per_bucket))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    kind = groups.schema["digest"].dataType.simpleString()
    now = stash(dealt.groupBy("bucket").applyInPandas(_first_level(shards), f"digest {kind}, weight long, bucket long, part int"), "parts")
    sums = now.groupBy("bucket", "part").agg(F.sum("weight").alias("weight"))
    place = now.select("digest", "bucket", "part")
    while buckets > 1:
        buckets = -(-buckets // FAN)
        level = stash(sums.groupBy(F.floor(F.col("bucket") / FAN).alias("above")).applyInPandas(_next_level(shards), "bucket long, part int, above long, to int, weight long"), "level")
        place = place.join(level.drop("weight"), ["bucket", "part"]).select("digest", F.col("above").alias("bucket"), F.col("to").alias("part"))
        sums = level.groupBy(F.col("above").alias("bucket"), F.col("to").alias("part")).agg(F.sum("weight").alias("weight"))
    return place.select("digest", F.col("part").alias("shard"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, per_bucket: int = GROUPS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of docs.

    size is the text's UTF-8 bytes plus 8. Rows with equal texts share a shard;
    a null text counts as empty. Shards have near equal bytes as far as groups
    allow: one group above a shard's fair part fills a shard alone. slot
    numbers a shard's rows without gaps from 0. Repeated rows and null ids stay
    and have slots of their own; an empty table gives an empty result; other
    columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stash(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "rows")
    groups = stash(rows.groupBy("digest").agg(F.sum("size").alias("weight")), "groups")
    where = stash(group_shards(groups, shards, per_bucket), "shards")
    chunks = max(1, -(-rows.count() // CHUNK))
    placed = stash(rows.join(where, "digest").withColumn("chunk", F.pmod(F.xxhash64("id", "digest"), F.lit(chunks))).drop("digest"), "placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("id", "size", "text_crc32"))
    numbered = placed.withColumn("nth", nth).join(first, ["shard", "chunk"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

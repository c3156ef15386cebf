"""Conflict-constrained best-fit packing of documents into bins of tokens.

A document longer than a bin is cut into full bins and a rest. Pieces are dealt
evenly to shards by a hash, and every shard packs its own, largest first. Open
bins stand in order of their residual room and carry bitmaps of the sources and
of the duplicate clusters they hold. The search starts at the tightest bin that
has room and goes on to the next until one shares neither source nor cluster
with the piece; only if none does a bin is opened.

A shard has about ``per_shard`` pieces whatever the corpus, so tasks have a
bounded size; what is lost against packing all at once is at most the room of
the last bins of each shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stash

#: Tokens of a bin; a token is a stretch without white space.
ROOM = 2_048
PER_SHARD = 4_096
#: Bins that a step of the search looks at.
STRIDE = 512


class Bins:
    """Bins in order of residual room, then of opening."""

    def __init__(self, room: int, sources: int, clusters: int, rows: int) -> None:
        self.room = room
        self.left = np.zeros(0, np.int64)  # room * rows + number, ascending
        self.rows = rows
        self.bits = [np.zeros((rows, max(1, -(-n // 64))), np.uint64) for n in (sources, clusters)]
        self.used = np.zeros(rows, np.int64)
        self.opened = 0

    def fit(self, size: int, source: int, cluster: int) -> int:
        """The tightest bin with room that holds neither; -1 if there is none. -1 stands for no source or cluster."""
        at = int(np.searchsorted(self.left, size * self.rows))
        while at < len(self.left):
            some = self.left[at : at + STRIDE] % self.rows
            free = np.ones(len(some), bool)
            for bits, k in zip(self.bits, (source, cluster), strict=True):
                if k >= 0:
                    free &= bits[some, k >> 6] >> np.uint64(k & 63) & np.uint64(1) == 0
            if free.any():
                return at + int(free.argmax())
            at += STRIDE
        return -1

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, tokens before the piece in it)."""
        at = self.fit(size, source, cluster)
        if at < 0:
            number, self.opened = self.opened, self.opened + 1
        else:
            number = int(self.left[at] % self.rows)
            self.left = np.delete(self.left, at)
        for bits, k in zip(self.bits, (source, cluster), strict=True):
            if k >= 0:
                bits[number, k >> 6] |= np.uint64(1) << np.uint64(k & 63)
        before = int(self.used[number])
        self.used[number] += size
        key = (self.room - before - size) * self.rows + number
        self.left = np.insert(self.left, np.searchsorted(self.left, key), key)
        return number, before


def _packer(room: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "cluster", "id", "piece"], ascending=[False, True, True, True], ignore_index=True)
        source, names = pd.factorize(rows["source"])  # -1 for null
        cluster, first = pd.factorize(rows["cluster"])
        alone = np.bincount(cluster[cluster >= 0], minlength=len(first)) < 2
        number = np.where(alone, -1, np.cumsum(~alone) - 1)  # a cluster of one can't be in conflict
        cluster = np.where(cluster >= 0, number[cluster] if len(number) else -1, -1)
        bins = Bins(room, len(names), int((~alone).sum()), len(rows))
        put = [bins.put(*x) for x in zip(rows["size"].tolist(), source.tolist(), cluster.tolist(), strict=True)]
        out = rows[["id", "piece", "start", "size", "shard"]].copy()
        out["bin"] = [b for b, _ in put]
        out["before"] = [x for _, x in put]
        return out

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", room: int = ROOM, per_shard: int = PER_SHARD) -> DataFrame:
    """(id, piece, start, n_tokens, bin, bin_start) for every piece of every row of docs.

    A row of n tokens has a piece of ``room`` tokens for each time that fits
    and one with the rest; start is the piece's first token in the text,
    bin_start its first place in its bin. No bin holds more than ``room``
    tokens, two pieces of one source or two of one duplicate cluster, which is
    all rows with the same text but for case and white space. A null source or
    a text without tokens is in conflict with nothing of that kind; a null or
    empty text has one piece of no tokens. Repeated rows are packed as often as
    they come; null ids stay null. An empty table gives an empty result; other
    columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit(r"\S+")).alias("n"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")).alias("same"))
    pieces = F.when(F.col("n") == 0, 1).otherwise(F.ceil(F.col("n") / room)).cast("int")
    cut = read.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    items = stash(
        cut.select(
            "id",
            "piece",
            (F.col("piece") * room).alias("start"),
            F.least(F.lit(room), F.col("n") - F.col("piece") * room).alias("size"),
            "source",
            F.when(F.col("n") > 0, F.col("same")).alias("cluster"),
        ),
        "pieces",
    )
    shards = max(1, -(-items.count() // per_shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "cluster", "source"), F.lit(shards)).cast("int"))
    schema = f"id {kind}, piece int, start int, size int, shard int, bin int, before int"
    packed = dealt.groupBy("shard").applyInPandas(_packer(room), schema)
    name = F.shiftleft(F.col("shard").cast("long"), 32) + F.col("bin")
    return packed.select(F.col("id").alias(id_col), "piece", "start", F.col("size").alias("n_tokens"), name.alias("bin"), F.col("before").alias("bin_start"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

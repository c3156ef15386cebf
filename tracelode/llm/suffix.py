"""Exact removal of repeated byte windows by a depth-limited radix sort.

Suffixes are ordered only through ``depth`` bytes, most significant digit
first, and a group that is down to one suffix is dropped at once. What is left
after the last digit are exactly the repeated windows.

The first digit deals the suffixes out over the cluster. It is the least
128-byte gram of the suffix's window, a function of the window's bytes alone,
so equal windows go to the same group at the same distance from their gram.
Windows in a row that share a gram travel as one run (about 140 suffixes), and
runs with equal bytes as one row with a count. A gram that occurs once ends its
suffixes there; a run that occurs twice is repeated as a whole. Only runs that
share a gram but differ somewhere (near copies, borders of shared passages) are
sorted further, in numpy, by the distance from the gram and by four digits of
128 bytes, and survivors are compared byte by byte. Runs are known by 64-bit
digests of their bytes together with their grams'.

A group of more than ``most`` different runs skips to the last digit: its
suffixes are dealt out by their whole window's 128-bit digest, so no task ever
holds one group of unbounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, documents, forget, stash
from .windows import anchors, digits

DEPTH, GRAM = 400, 128
#: Bytes of a passage that the query counts where it repeats, some forty words.
PASSAGE = 256
#: Different runs of one gram that a task may sort; 20,000 runs are 11 MB.
MOST = 20_000
#: Bytes of runs that a task sorts together.
TOGETHER = 2_000_000


def _packed(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First window, windows after it (10 bits) and distance of the gram (10 bits) in a long."""
    return first << 20 | (last - first) << 10 | place - first


@F.pandas_udf(T.BinaryType())
def _squeezed(texts: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([press(t.encode()) for t in texts])


def _runs(depth: int, gram: int):
    """A mapInPandas function: texts to their runs, an array each of grams, run digests and places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                data = text.encode()
                if len(data) >= depth:
                    first, last, place, grams = anchors(data, depth, gram)
                    parts = zip(first.tolist(), last.tolist(), (place - first).tolist(), strict=True)
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(data[a : b + depth], d) for a, b, d in parts), np.uint64, len(first))
                    rows.append((k1, k2, grams, digest.view(np.int64), _packed(first, last, place)))
            yield pd.DataFrame(rows, columns=["k1", "k2", "gram", "run", "at"])

    return run


def _cut(depth: int):
    """A mapInPandas function: texts with lists of runs to the runs' bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for squeezed, grams, runs, places, single in zip(*(batch[c] for c in ("data", "grams", "runs", "places", "single")), strict=True):
                data = open_(squeezed)
                for g, r, at, one in zip(grams, runs, places, single, strict=True):
                    first, more, far = at >> 20, at >> 10 & 1023, at & 1023
                    out.append((g, r, one, far, data[first : first + more + depth]))
            yield pd.DataFrame(out, columns=["gram", "run", "single", "far", "data"])

    return run


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that aren't alone, group by group, and where each group begins."""
    order = np.argsort(key, kind="stable")
    if not len(order):
        return order, order
    same = key[order][1:] == key[order][:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    order, new = order[keep], np.r_[True, ~same][keep]
    return order, np.flatnonzero(new)


def repeated(group: np.ndarray, far: np.ndarray, runs: list[bytes], depth: int, gram: int) -> np.ndarray:
    """For each window of the runs, in turn, whether its bytes occur again at the same distance in its group."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    windows = sizes - depth + 1
    owner = np.repeat(np.arange(len(runs)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
    data = np.frombuffer(b"".join(runs), np.uint8)
    digit = digits(data, gram)
    key = _mixed(group[owner].astype(np.int64).view(np.uint64), (far[owner] - inside).astype(np.int64).view(np.uint64))
    alive = np.arange(len(owner))
    for step in [*range(0, depth - gram, gram), depth - gram]:  # most significant digit first
        key = _mixed(key, digit[place[alive] + step])
        order, _ = _groups(key)
        alive, key = alive[order], key[order]
    order, begins = _groups(key)
    alive = alive[order]
    leader = np.repeat(alive[begins], np.diff(np.r_[begins, len(alive)]))
    found = np.zeros(len(owner), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, depth)
    for i in range(0, len(alive), 2048):
        a, b = alive[i : i + 2048], leader[i : i + 2048]
        equal = (view[place[a]] == view[place[b]]).all(axis=1) & (group[owner[a]] == group[owner[b]])
        found[a[equal]] = True
        if not equal.all():  # digests of different windows have met: those are told apart by their bytes
            odd = np.isin(leader, np.unique(b[~equal]))
            seen: dict[tuple[int, bytes], int] = {}
            names = [(int(group[owner[x]]), view[place[x]].tobytes()) for x in alive[odd]]
            for name in names:
                seen[name] = seen.get(name, 0) + 1
            found[alive[odd]] = [seen[name] > 1 for name in names]
            leader = np.where(odd, alive, leader)
    return found


def _between(flags: np.ndarray) -> np.ndarray:
    """First and last place of each run of true flags, in turn."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1]).ravel()


def _sorted_out(depth: int, gram: int):
    """A mapInPandas function over runs sorted by gram: the repeated windows of runs that occur once."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["gram", "run"])
        runs = rows["data"].tolist()
        found = repeated(rows["gram"].to_numpy(np.int64), rows["far"].to_numpy(np.int64), runs, depth, gram)
        ends = np.cumsum([len(r) - depth + 1 for r in runs])
        out = []
        for g, r, one, a, b in zip(rows["gram"], rows["run"], rows["single"], np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            if one and found[a:b].any():
                out.append((g, r, _between(found[a:b])))
        return pd.DataFrame(out, columns=["gram", "run", "windows"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                kept.append(batch.iloc[at : at + 2_000])
                if sum(int(k["data"].str.len().sum()) for k in kept) < TOGETHER:
                    continue
                rows = pd.concat(kept, ignore_index=True)
                cut = int(np.searchsorted(rows["gram"].to_numpy(np.int64), rows["gram"].iloc[-1]))
                if cut:
                    yield settle(rows.iloc[:cut])
                kept = [rows.iloc[cut:]]
        if kept and sum(map(len, kept)):
            yield settle(pd.concat(kept, ignore_index=True))

    return run


def _last_digit(depth: int):
    """A mapInPandas function: runs to a row for each window, with 128 bits of digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, r, one, far, data in zip(*(batch[c] for c in ("gram", "run", "single", "far", "data")), strict=True):
                each = [xxhash.xxh3_128_digest(data[i : i + depth]) for i in range(len(data) - depth + 1)]
                half = np.frombuffer(b"".join(each), ">i8").astype(np.int64).reshape(-1, 2)
                inside = np.arange(len(each))
                yield pd.DataFrame({"gram": g, "run": r, "single": one, "inside": inside, "distance": far - inside, "d1": half[:, 0], "d2": half[:, 1]})

    return run


def _settled_apart(runs: DataFrame, depth: int) -> DataFrame:
    """As _sorted_out, for groups too large for a task: windows are counted by their digest."""
    each = stash(runs.dropDuplicates(["gram", "run"]).mapInPandas(_last_digit(depth), "gram long, run long, single boolean, inside int, distance int, d1 long, d2 long"), "windows")
    name = ["gram", "distance", "d1", "d2"]
    twice = each.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return each.where("single").join(twice, name, "left_semi").groupBy("gram", "run").agg(F.sort_array(F.flatten(F.collect_list(F.array("inside", "inside")))).alias("windows"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, text): the keys name a row by its id and text, so copies with other ids are told apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, F.lit(7), id_col).alias("k2"), text.alias("text"))


def _spans(windows, depth: int) -> list[list[int]]:
    """Byte ranges that windows cover, given as first and last window in turn."""
    spans: list[list[int]] = []
    if windows is not None and len(windows):
        pairs = np.asarray(windows, np.int64).reshape(-1, 2)
        for a, b in pairs[np.argsort(pairs[:, 0])].tolist():
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b + depth)
            else:
                spans.append([a, b + depth])
    return spans


def _without(depth: int, passage: int):
    """A mapInPandas function: texts with the repeated windows to what is left of them, and the bytes in repeated passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for id_, squeezed, windows, passages in zip(batch["id"], batch["data"], batch["windows"], batch["passages"], strict=True):
                data = open_(squeezed)
                spans = _spans(windows, depth)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((id_, len(data), [x for s in spans for x in s], kept, sum(b - a for a, b in _spans(passages, passage))))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept", "n_passage"]).astype({"id": batch["id"].dtype})

    return run


def _repeats(rows: DataFrame, depth: int, gram: int, most: int) -> DataFrame:
    """(k1, k2, windows) of the keyed texts with repeated windows: first and last window of each stretch, in turn."""
    key = ["k1", "k2"]
    runs = stash(rows.select("k1", "k2", "text").mapInPandas(_runs(depth, gram), "k1 long, k2 long, gram array<long>, run array<long>, at array<long>"), "runs")
    each = runs.select("k1", "k2", F.inline(F.arrays_zip("gram", "run", "at")))
    common = stash(runs.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "common")
    # Written first, so that the join has a plain exchange on either side and hot grams can be split.
    shared = stash(each.join(common, "gram"), "shared")
    forget(runs, common)
    known = stash(shared.groupBy("gram", "run").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("first")), "known")
    several = known.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1")
    unsure = known.join(several, "gram").select("gram", "run", F.col("n").eqNullSafe(1).alias("single"), "different", "first.*")
    lists = unsure.groupBy(key).agg(*[F.collect_list(c).alias(f"{c}s") for c in ("gram", "run")], F.collect_list("at").alias("places"), F.collect_list("single").alias("single"))
    texts = rows.select(*key, _squeezed("text").alias("data"))
    cut = texts.join(lists, key).select("data", "grams", "runs", "places", "single").mapInPandas(_cut(depth), "gram long, run long, single boolean, far int, data binary")
    largest = several.agg(F.max("different")).first()[0] or 0
    if largest > most:
        cut = stash(cut, "cut")
        large = several.where(F.col("different") > most).select("gram")
        apart = _settled_apart(cut.join(large, "gram", "left_semi"), depth)
        cut = cut.join(large, "gram", "left_anti")
    settled = cut.repartition("gram").sortWithinPartitions("gram").mapInPandas(_sorted_out(depth, gram), "gram long, run long, windows array<long>")
    if largest > most:
        settled = settled.unionByName(apart.withColumn("windows", F.col("windows").cast("array<long>")))
    whole = known.where("n > 1").select("gram", "run", F.array(F.lit(0), F.shiftright("first.at", 10).bitwiseAND(1023)).cast("array<long>").alias("windows"))
    hit = shared.join(whole.unionByName(settled), ["gram", "run"]).select(*key, F.transform("windows", lambda x: x + F.shiftright("at", 20)).alias("windows"))
    gone = stash(hit.groupBy(key).agg(F.flatten(F.collect_list("windows")).alias("windows")), "gone")
    forget(shared, known)
    return gone


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, most: int = MOST, passage: int | None = None) -> DataFrame:
    """(id, n_bytes, spans, kept, n_passage) for every row of docs.

    ``spans`` are the removed byte ranges, start and end in turn: all bytes
    covered by a ``depth``-byte string that also starts anywhere else in the
    texts, the same text included. ``kept`` are the other bytes, which may
    begin or end inside a character. ``n_passage`` are the bytes covered by
    strings of ``passage`` bytes, by the same rule; nothing is removed for
    them, and without a ``passage`` they are 0. A null text counts as empty; a
    text shorter than ``depth`` stays whole, one of any length is read to its
    end. Repeated rows are copies of each other, so all of a text of ``depth``
    bytes or more that occurs twice goes. Null ids stay null. An empty table
    gives an empty result; other columns are not looked at. ``gram`` is a power
    of two below ``depth`` and ``passage``.
    """
    rows = _keyed(docs, id_col, text_col)
    key = ["k1", "k2"]
    texts = rows.select("id", *key, _squeezed("text").alias("data"))
    if passage:
        passages = _repeats(rows, passage, gram, most)
        texts = texts.join(passages.withColumnRenamed("windows", "passages"), key, "left")
        if passage < depth:
            # A repeated string holds that many repeated passages, so texts with fewer have none of its length.
            signed = F.transform("windows", lambda x, i: F.when(i % 2 == 1, x + 1).otherwise(-x))
            enough = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x) > depth - passage
            rows = among(rows, passages.where(enough).select(*key), key)
    else:
        texts = texts.withColumn("passages", F.lit(None).cast("array<long>"))
    texts = texts.join(_repeats(rows, depth, gram, most), key, "left")
    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.select("id", "data", "windows", "passages").mapInPandas(_without(depth, passage or 0), f"id {kind}, n_bytes long, spans array<long>, kept binary, n_passage long")
    return found.withColumnRenamed("id", id_col)


def op2_suffix(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir), passage=PASSAGE)
    removed = found["n_bytes"] - F.octet_length("kept").cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage")

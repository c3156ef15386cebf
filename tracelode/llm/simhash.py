"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a point in the middle: the balls
of half the radius around them meet. Every distinct fingerprint emits all
variants of its 64 bits within half the radius, 2,081 of them at radius 4, a
shuffle brings equal variants together, and colliding pairs are verified.

Variants that agree in their first bits travel together: all that a fingerprint
has in such a class follow from the fingerprint, so one row stands for them and
they are written out only where the class is read. A fingerprint has variants in
1 + b + b (b - 1) / 2 classes of b bits, 56 at ten bits instead of 2,081 rows; b
grows with the number of fingerprints, so that a class keeps its size.

``near_copies`` links texts by the share of their five-word shingles instead and
loses no link either. All shingles have one order, those that a sample finds
common last. By the prefix principle two texts with four fifths in common share
one of the first shingles of each, a fifth of its set and one more; a shuffle
brings equal ones together, counts of shingles by bucket bound what a pair can
have in common, and what is left is verified by exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS, among, batches_of, documents, forget, stash
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Variants of a class on the average, by which the bits of classes are chosen, and so many at most that a task sorts together.
VARIANTS, AT_ONCE = 1 << 19, 1 << 21
#: Shingles whose bits are counted at once, so a very long text needs no more memory.
BLOCK = 1 << 15
#: near_copies: words of a shingle, and the fraction of common shingles from which texts are copies.
COPY_SHINGLE, SIMILAR = 5, (4, 5)
#: One text in so many is looked at for common shingles: those that it has so often, and so many of them at most, come last. They order shingles only, so no link depends on them.
SAMPLED, COMMON, MOST_COMMON = 16, 3, 200_000
#: Buckets of a text's counts of shingles, a power of two.
BUCKETS = 128
#: Up to so many texts with a shingle are compared pair by pair at once; beyond, with one of them first, and then where groups are still apart.
FEW = 16
#: A larger group is compared so many times with so many of its texts, those with the most links so far, before all pairs still apart are.
ROUNDS, HUBS = 2, 2
#: Pairs given on at once.
CHUNK = 200_000


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in blocks.

    A-Z become lower case and words end at ASCII white space, which is what
    bytes.lower() and bytes.split() do. Fewer words than a shingle make one.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    last = min(shingle, len(words)) - 1
    total, digest = len(words) - last, xxhash.xxh64_intdigest
    for i in range(0, total, BLOCK):
        j = min(total, i + BLOCK)
        pairs = zip(start[i:j].tolist(), end[i + last : j + last].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, j - i)


def _bits(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit, least bit of the first column first."""
    return np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of one text; 0 without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        ones += _bits(hashes)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def shingle_set(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def _points(common: pd.DataFrame):
    """A function of texts: hash and size of the set of shingles, its first ones in the order (count in the sample, hash), and its counts by bucket."""
    common = common.assign(hash=common["hash"].to_numpy(np.int64).view(np.uint64)).sort_values("hash")
    known, often = common["hash"].to_numpy(np.uint64), common["often"].to_numpy(np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)

    def point(text: str | None) -> tuple:
        found = shingle_set(text)
        size, first = len(found), found
        if len(known):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            first = found[np.argsort(np.where(known[at] == found, often[at], 0), kind="stable")]
        # A partner has -(-size * 4 // 5) of the shingles at least, so not all of so many are missing.
        first = first[: size + 1 - -(-size * SIMILAR[0] // SIMILAR[1])]
        counts = np.bincount((found >> shift).astype(np.int64), minlength=BUCKETS)
        counts = counts.astype("<u1" if counts.max() < 256 else "<u4")  # told apart by their length
        return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63), size, first.view(np.int64), counts.tobytes()

    @F.pandas_udf("fp long, size int, first array<long>, counts binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([point(t) for t in texts], columns=["fp", "size", "first", "counts"])

    return run


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


@lru_cache(maxsize=256)
def masks(bits: int, flips: int) -> np.ndarray:
    """Every word of so many bits with at most so many ones."""
    return np.array([sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)], np.uint64)


def _equal(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners of equal keys, each with the owner of the first of them."""
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    first = owner[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    return owner[~new], first[~new]


def _variants_met(fp: np.ndarray, flips: np.ndarray, left: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints with a variant in common, among variants of one class.

    ``flips`` bits of a fingerprint are changed already to be in the class, and
    its variants differ from it in the last ``left`` bits, half in all at most.
    Too many variants are taken apart by four bits more.
    """
    balls = [masks(left, n) for n in range(half + 1)]
    some = [np.flatnonzero(flips == n) for n in range(half + 1)]
    total = sum(len(x) * len(balls[half - n]) for n, x in enumerate(some))
    if total > AT_ONCE and left > 4:
        top = (fp >> np.uint64(left - 4)) & np.uint64(15)
        for value in range(16):
            now = flips + np.bitwise_count(top ^ np.uint64(value))
            at = np.flatnonzero(now <= half)
            if len(at) > 1:
                for a, b in _variants_met(fp[at], now[at], left - 4, half):
                    yield at[a], at[b]
        return
    low = fp & np.uint64((1 << left) - 1)
    keys = np.concatenate([(low[x][:, None] ^ balls[half - n][None, :]).ravel() for n, x in enumerate(some)])
    yield _equal(keys, np.concatenate([np.repeat(x, len(balls[half - n])) for n, x in enumerate(some)]))


def _collide(radius: int, bits: int):
    """A mapInPandas function over rows (class, fp) sorted by class: verified links (a, b).

    All fingerprints with one variant are within the radius of each other, so
    each is linked with the first of them, never with all. The last class of a
    batch waits for the next batch.
    """
    half = radius // 2

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
        out = [np.zeros((0, 2), np.int64)]
        for i, j in zip(edge, edge[1:]):
            some = fp[i:j]
            flips = np.bitwise_count((some >> np.uint64(64 - bits)) ^ np.uint64(key[i])).astype(np.int64)
            for a, b in _variants_met(some, flips, 64 - bits, half):
                pair = np.unique(np.maximum(a, b) * len(some) + np.minimum(a, b))
                a, b = some[pair // len(some)], some[pair % len(some)]
                near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
                out.append(np.column_stack([a[near].view(np.int64), b[near].view(np.int64)]))
        a, b = np.concatenate(out).T
        yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch["key"].to_numpy(np.int64)])
            fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield from links(key, fp)

    return run


def class_bits(fingerprints: int, radius: int = RADIUS) -> int:
    """First bits by which so many fingerprints are dealt into classes of about VARIANTS variants."""
    return min(24, max(4, (fingerprints * len(masks(64, radius // 2)) // VARIANTS).bit_length()))


def ball_links(fingerprints: DataFrame, radius: int = RADIUS, bits: int | None = None) -> DataFrame:
    """Verified links (a, b), a > b, that connect the distinct fingerprints (fp) within radius bits, an even number.

    ``bits`` is how many first bits of a variant name its class; it changes how
    the work is dealt out and not what is found.
    """
    if radius % 2:
        raise ValueError("balls meet in the middle of an even radius only")
    bits = class_bits(fingerprints.count(), radius) if bits is None else bits
    flips = F.explode(F.array(*[F.lit(int(m)).cast("long") for m in masks(bits, radius // 2)]))
    rows = fingerprints.select("fp", flips.alias("flip")).select(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("flip")).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_collide(radius, bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    component_id is the least id among all rows reachable over links of at most
    ``radius`` differing bits, the row's own included. Null, empty and blank
    texts have fingerprint 0, linked like any other. A null id never is the
    least one; a component of null ids only has a null component_id. Repeated
    rows stay repeated; an empty table gives an empty result; other columns,
    whatever their names, are not looked at.

    Copies of a text share a fingerprint and travel as one row, so a group of
    copies of any size is one point of the search.
    """
    prints = stash(docs.select(F.col(id_col).cast("long").alias("id"), simhash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("fp")), "prints")
    distinct = stash(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(ball_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stash(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(names, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key in frames that end where a key does."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy(np.int64)
        if held and held[0]["key"].iat[0] != key[-1]:
            some = pd.concat([*held, batch], ignore_index=True)
            cut = int(np.searchsorted(some["key"].to_numpy(np.int64), key[-1]))
            yield some.iloc[:cut]
            held = [some.iloc[cut:]]
        elif not held and (cut := int(np.searchsorted(key, key[-1]))):
            yield batch.iloc[:cut]
            held = [batch.iloc[cut:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _may(size: np.ndarray, at: np.ndarray, size2: np.ndarray, at2: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle is at these places can have four fifths in common."""
    return np.minimum(size - at, size2 - at2) * (SIMILAR[0] + SIMILAR[1]) >= (size + size2) * SIMILAR[0]


def _pairs(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)}).drop_duplicates()


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, fp, size, at) sorted by key, at and fp to pairs (a, b), a > b, that may be alike.

    Of a key with more than FEW rows the pairs with its first row, and its rows
    themselves as well, with many set and fp in a. The first row has the fewest
    shingles that are rarer than the key, so in a family of copies it is one of
    those with the fewest words of its own, and near to the most others.
    """
    for some in _whole_keys(batches):
        key, fp, size, at = (some[c].to_numpy(np.int64) for c in ("key", "fp", "size", "at"))
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        n = np.diff(edge)
        few = np.repeat(n <= FEW, n)
        found = []
        for lag in range(1, min(FEW, int(n.max()))):
            i = np.flatnonzero((key[:-lag] == key[lag:]) & few[lag:])
            i = i[_may(size[i], at[i], size[i + lag], at[i + lag])]
            found.append((fp[i], fp[i + lag]))
        j, hub = np.flatnonzero(~few), np.repeat(edge[:-1], n)
        near = j[(j != hub[j]) & _may(size[j], at[j], size[hub[j]], at[hub[j]])]
        found.append((fp[near], fp[hub[near]]))
        yield _pairs(*(np.concatenate(x) for x in zip(*found, strict=True))).assign(many=False, key=0, size=0, at=0)
        yield pd.DataFrame({"a": fp[j], "b": 0, "many": True, "key": key[j], "size": size[j], "at": at[j]})


def _across(turn: int | None):
    """A mapInPandas function: (key, fp, size, at, root, degree) sorted by key to pairs (a, b), a > b, of different roots that may be alike.

    Of each key those with the HUBS rows that have the most links, the next ones
    each turn; without a turn all. A text that many are near to is found to be
    one, and settles its group in a turn.
    """

    def found(fp: np.ndarray, size: np.ndarray, at: np.ndarray, root: np.ndarray, degree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        roots, which, n = np.unique(root, return_inverse=True, return_counts=True)
        if len(roots) < 2:
            return
        hubs = np.lexsort((fp, at, -degree))[turn * HUBS : (turn + 1) * HUBS].tolist() if turn is not None else np.flatnonzero(which != n.argmax()).tolist()
        open_ = np.ones(len(fp), bool)
        for hub in hubs:
            open_[hub] = False
            j = np.flatnonzero(open_ & (root != root[hub]))
            j = j[_may(size[j], at[j], size[hub], at[hub])]
            if len(j):
                yield fp[j], np.full(len(j), fp[hub])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _whole_keys(batches):
            key, *rest = (some[c].to_numpy(np.int64) for c in ("key", "fp", "size", "at", "root", "degree"))
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
            held, count = [], 0
            for i, j in zip(edge, edge[1:]):
                for pair in found(*(np.ascontiguousarray(x[i:j]) for x in rest)):
                    held.append(pair)
                    count += len(pair[0])
                    if count > CHUNK:
                        yield _pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        held, count = [], 0
            if held:
                yield _pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


@F.pandas_udf(T.BooleanType())
def _enough(x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether counts by bucket leave room for four fifths in common."""
    wide = lambda c: np.frombuffer(c, "<u1" if len(c) == BUCKETS else "<u4")
    x, y = (np.array([wide(c) for c in side], np.int32).reshape(-1, BUCKETS) for side in (x, y))
    return pd.Series(np.minimum(x, y).sum(axis=1) * (SIMILAR[0] + SIMILAR[1]) >= (x.sum(axis=1) + y.sum(axis=1)) * SIMILAR[0])


def _possible(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The different pairs (a, b) that counts by bucket, by the table (fp, counts), don't rule out."""
    both = pairs.distinct().join(counts.select(F.col("fp").alias("a"), F.col("counts").alias("x")), "a").join(counts.select(F.col("fp").alias("b"), F.col("counts").alias("y")), "b")
    return both.where(_enough("x", "y")).select("a", "b")


def _common(rows: DataFrame) -> pd.DataFrame:
    """(hash, often): shingles that a sample of the texts finds common."""
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select(F.explode(_shingles("text")).alias("hash"))
    return drawn.groupBy("hash").agg(F.count("*").alias("often")).where(F.col("often") >= COMMON).orderBy(F.desc("often"), "hash").limit(MOST_COMMON).toPandas()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles, by the table (fp, set), are common to four fifths."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where(common * (SIMILAR[0] + SIMILAR[1]) >= total * SIMILAR[0]).select("a", "b")


def _mark_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a > b, that connect the points (fp) of texts whose fingerprints (mark) are within radius bits."""
    marks = stash(prints.select("fp", "mark").distinct(), "marks")
    # A fingerprint stands by its least point; texts with one set of shingles may have several, as repeats count.
    one = stash(marks.groupBy("mark").agg(F.min("fp").alias("least")), "one")
    same = marks.join(one, "mark").where("fp <> least").select("fp", "least")
    of = lambda side, name: one.select(F.col("mark").alias(side), F.col("least").alias(name))
    near = ball_links(one.select(F.col("mark").alias("fp")), radius).join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select("x", "y")
    return stash(same.union(near).select(F.greatest("fp", "least").alias("a"), F.least("fp", "least").alias("b")).distinct(), "near")


def _roots(rows: DataFrame, ids: list[str], radius: int | None = None) -> DataFrame:
    """(*ids, copy, root) for every row of (*ids, text): a digest of its text, and the component of its set of shingles.

    With a radius, fingerprints within so many bits are links as well.
    """
    spark = rows.sparkSession
    mark = [] if radius is None else [simhash("text").alias("mark")]
    with batches_of(spark, TEXTS):
        prints = stash(rows.select(*ids, F.xxhash64("text").alias("copy"), _points(_common(rows))("text").alias("point"), *mark).select(*ids, "copy", "point.*", *["mark"] * len(mark)), "prints")
    marked = None if radius is None else _mark_links(prints, radius)
    # Copies first, so that a group of any size is one row of the join for texts.
    distinct = stash(prints.groupBy("fp").agg(F.min(F.struct("copy", "size", "first", "counts")).alias("one")).select("fp", "one.*"), "distinct")
    named = stash(prints.select(*ids, "copy", "fp"), "named")
    forget(prints)
    keyed = distinct.select("fp", "size", F.posexplode("first").alias("at", "key"))
    met = stash(keyed.repartition("key").sortWithinPartitions("key", "at", "fp").mapInPandas(_meet, "a long, b long, many boolean, key long, size int, at int"), "met")
    many = met.where("many").select("key", F.col("a").alias("fp"), "size", "at")
    sets: list[DataFrame] = []
    links: list[DataFrame] = []

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that have four fifths in common; shingles are only read for texts of a pair."""
        asked = stash(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "asked")
        new = asked
        for known in sets:
            new = new.join(known.select("fp"), "fp", "left_anti")
        new = stash(among(distinct.select("fp", "copy"), new, "fp"), "new")
        texts = among(rows.withColumn("copy", F.xxhash64("text")), new.select("copy"), "copy").groupBy("copy").agg(F.min("text").alias("text"))
        with batches_of(spark, TEXTS):
            sets.append(stash(new.join(texts, "copy").select("fp", _shingles("text").alias("set")), "sets"))
        held = reduce(DataFrame.unionByName, sets)
        links.append(stash(_alike(pairs, among(held, asked, "fp")), "alike"))
        return links[-1]

    pairs = stash(_possible(met.where("not many").select("a", "b"), distinct), "pairs")
    linked = alike(pairs)
    roots = stash(components(linked if marked is None else linked.unionByName(marked)), "roots")
    for turn in [*range(ROUNDS), None]:
        ends = reduce(DataFrame.unionByName, links).select(F.explode(F.array("a", "b")).alias("fp"))
        known = roots.withColumnRenamed("node", "fp").join(ends.groupBy("fp").agg(F.count("*").alias("degree")), "fp", "full")
        now = many.join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp")).fillna(0, ["degree"])
        apart = now.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_across(turn), "a long, b long")
        pairs = stash(_possible(apart, distinct), "pairs")
        if not pairs.isEmpty():
            roots = stash(components(alike(pairs).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    found = stash(named.join(roots, named["fp"] == roots["node"], "left").select(*ids, "copy", F.coalesce("root", "fp").alias("root")), "found")
    forget(distinct, met, named, *sets)
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row of docs, linked at four fifths or more of common five-word shingles.

    No link is lost, whatever the length of a text, and each stands by the exact
    share of common shingles. Texts with equal sets of shingles are one point.
    Where many texts have a shingle they are compared with one of them first,
    then with those that have the most links, then in all pairs that are still in different
    components. component_id is the least id reachable; nulls, repeats and
    empty tables are treated as near_duplicates treats them. Texts without
    words are copies of each other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _roots(rows, ["id"])
    least = found.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the least id stays.

    Two texts are linked if their fingerprints are within RADIUS bits, as near_duplicates
    has it, and also at four fifths of common shingles (see near_copies), as short texts
    so near may have fingerprints further apart. Columns and their order stay. A null id comes after all others, and among
    equal ids the text with the least digest stays. Rows alike in id and text
    are one row, whatever their other columns hold.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _roots(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")), ["id"], RADIUS)
    row = F.struct(F.col("id").isNull().alias("last"), "id", "copy")
    ranked = found.groupBy("root").agg(F.min(row).alias("stays"))
    kept = stash(ranked.select("root", F.col("stays.id").alias("kept_id"), F.col("stays.copy").alias("kept_copy")), "kept")
    goes = ~(F.col("id").eqNullSafe(F.col("kept_id")) & F.col("copy").eqNullSafe(F.col("kept_copy")))
    gone = stash(found.join(kept, "root").where(goes).select(F.col("id").alias("_gone_id"), F.col("copy").alias("_gone_copy")).distinct(), "gone")
    total, different = found.agg(F.count("*"), F.countDistinct(F.struct("id", "copy"))).first()
    copy = "_copy_of_text"
    while copy in docs.columns:  # whatever the user's own columns are called
        copy += "_"
    named = docs.withColumn(copy, F.xxhash64(text))
    if total > different:
        named = named.dropDuplicates([id_col, copy])
    same = named[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (named[copy] == gone["_gone_copy"])
    return among(named, gone, same, "left_anti").drop(copy)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

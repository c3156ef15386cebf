"""MinHash near-duplicates with sequential Bayesian verification.

Different sets of shingles get a signature of minima. Sets that agree in a band of
the signature are candidates. A candidate pair is compared by batches of its
signatures: with a uniform prior, m matches among n minima leave a posterior for
the similarity, and a pair whose similarity reaches the threshold with less than the
chosen miss probability is dropped after that batch. What is left is verified
on the full sets, so every link stands by exact counts.

No group is compared pair by pair because it shares a band. Up to FEW sets are; of
a larger group each is compared with one of them, then with the one that has
the most links. Members that are still in different components are known by how
they differ from the shingles that most of their family have. Two sets differ
from each other exactly where these differences do, so those with few are linked
with the one that has the fewest, and any other link needs a difference in common
that is rare enough: a prefix join over differences, which near copies of one text
that aren't near enough to each other hardly ever share.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, batches_of, documents, forget, stash
from .components import components
from .simhash import shingle_set

SHINGLE, SIMILAR = 4, (80, 100)
#: Bands and minima of a band; two sets at the threshold miss all bands once in 2e7.
BANDS, ROWS = 32, 4
#: Sets of n and m shingles are similar if EACH times the size of their symmetric difference is ROOM * (n + m) at most.
EACH, ROOM = SIMILAR[1] + SIMILAR[0], SIMILAR[1] - SIMILAR[0]
#: Parities of a set's values; two sets differ in as many of them as in values at most.
SLOTS = 1024
#: Minima compared at once, and the posterior probability of reaching the threshold below which a pair is dropped.
BATCH, MISS = 32, 1e-9
#: Sets with a band that are compared pair by pair.
FEW = 16
#: Hashes that are made at once, and texts in a batch.
BLOCK, TEXTS = 1 << 18, 500


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.array([xxhash.xxh64_intdigest(f"{what}{i}".encode()) for i in range(n)], np.uint64)[:, None] for what in "ab")
    return a | np.uint64(1), b


def signature(found: np.ndarray, minima: int) -> np.ndarray:
    """The low 16 bits of the least value of the set under each of so many hash functions."""
    a, b = _multipliers_of(minima)
    least = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
    step = max(8, BLOCK // minima)
    for i in range(0, len(found), step):
        least = np.minimum(least, (found[None, i : i + step] * a + b).min(axis=1))
    return least.astype("<u2")


_HELD: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _multipliers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _HELD:
        _HELD[n] = _multipliers(n)
    return _HELD[n]


def least_matches(minima: int, batch: int = BATCH, miss: float = MISS, similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """(n, m) after each batch: of n minima m have to match, or the pair is dropped.

    With a uniform prior the similarity given m of n is Beta(m + 1, n - m + 1),
    which reaches s with the probability that a binomial of n + 1 trials at s is m at most.
    """
    s, found = similar[0] / similar[1], []
    for n in range(batch, minima + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        found.append((n, m))
    return found


def likely(x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signatures (rows of x and y) outlast all batches; later ones are looked at only for pairs that outlast earlier ones."""
    left, matches, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, m in bounds:
        matches[left] += (x[left, at:n] == y[left, at:n]).sum(axis=1)
        left, at = left[matches[left] >= m], n
    out = np.zeros(len(x), bool)
    out[left] = True
    return out


@F.pandas_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("sig", T.BinaryType())]))
def _sketch(texts: pd.Series) -> pd.DataFrame:
    """A digest of each text's set of shingles, its size and its signature."""
    rows = []
    for text in texts:
        found = shingle_set(text, SHINGLE)
        rows.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), signature(found, BANDS * ROWS).tobytes() if len(found) else b""))
    return pd.DataFrame(rows, columns=["key", "n", "sig"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t, SHINGLE).view(np.int64) for t in texts])


def _band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """A long for each band of each row of signatures."""
    words = np.ascontiguousarray(minima).view(np.uint64).reshape(len(minima), -1, rows // 4)
    mixed = np.arange(words.shape[1], dtype=np.uint64)[None] + np.zeros((len(minima), 1), np.uint64)
    for k in range(words.shape[2]):
        mixed = (mixed ^ words[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(sigs: pd.Series) -> pd.Series:
    return pd.Series(list(_band_keys(np.array([np.frombuffer(s, "<u2") for s in sigs]).reshape(len(sigs), -1), ROWS)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _parities(sets: pd.Series) -> pd.Series:
    """For each of SLOTS, as bits of longs, whether an odd number of the set's values falls into it."""
    odd = [np.bincount(np.asarray(s, np.int64).view(np.uint64) % np.uint64(SLOTS), minlength=SLOTS).astype(np.uint8) & 1 for s in sets]
    return pd.Series([np.packbits(o).view(np.int64) for o in odd], dtype=object)


def _outlasts(bounds: list[tuple[int, int]]):
    @F.pandas_udf(T.BooleanType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (np.array([np.frombuffer(s, "<u2") for s in side]).reshape(len(side), -1) for side in (x, y))
        return pd.Series(likely(*both, bounds))

    return run


def _sized(x: Column | str, y: Column | str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) * SIMILAR[1] >= F.greatest(x, y) * SIMILAR[0]


def _groups(rows: DataFrame) -> DataFrame:
    """(key, size, rank, hub, hub_n, hub_root) of each key of rows (key, node, n, root, rank) whose nodes have different roots; the hub has the least rank."""
    told = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("rank", "node", "n", "root")).alias("least"))
    return told.where("low < high").select("key", "size", F.col("least.node").alias("hub"), F.col("least.n").alias("hub_n"), F.col("least.root").alias("hub_root"))


def _stars(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b), a > b: each of the rows with the hub of its group, where both are in different components."""
    near = among(rows, groups, "key", "inner").where((F.col("root") != F.col("hub_root")) & _sized("n", "hub_n"))
    return near.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))


def _small_groups(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b), a > b: all pairs of a key that is none of the large ones and has different roots; FEW nodes at most are together."""
    held = among(rows.select("key", "node", "n", "root"), large.select("key"), "key", "left_anti").groupBy("key")
    held = held.agg(F.sort_array(F.collect_list(F.struct("node", "n", "root"))).alias("m")).where(F.size("m") > 1)
    met = held.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).where("x.node > y.node and x.root <> y.root").where(_sized("x.n", "y.n"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


class _Search:
    """The links found so far between distinct sets (node, n, sig, copy), and their components."""

    def __init__(self, texts: DataFrame, distinct: DataFrame):
        self.texts, self.distinct = texts, distinct
        self.sets: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.roots: DataFrame | None = None
        self.likely = _outlasts(least_matches(BANDS * ROWS))

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of these nodes (node); texts are read for those that weren't asked for before."""
        new = nodes
        for known in self.sets:
            new = new.join(known.select("node"), "node", "left_anti")
        new = stash(among(self.distinct.select("node", "copy"), new, "node"), "new")
        held = among(self.texts, new.select("copy"), "copy").groupBy("copy").agg(F.min("text").alias("text"))
        with batches_of(nodes.sparkSession, TEXTS):
            self.sets.append(stash(new.join(held, "copy").select("node", _shingles("text").alias("set")), "sets"))
        return among(reduce(DataFrame.unionByName, self.sets), nodes, "node")

    def add(self, pairs: DataFrame) -> None:
        """Link those of the pairs that outlast the batches and are similar on their full sets."""
        sig = self.distinct.select("node", "sig")
        both = pairs.distinct().join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
        pairs = stash(both.where(self.likely("x", "y")).select("a", "b"), "likely")
        if pairs.isEmpty():
            return
        sets = self.sets_of(stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked"))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
        self.links.append(stash(both.where(common * SIMILAR[1] >= (total - common) * SIMILAR[0]).select("a", "b"), "links"))
        known = [] if self.roots is None else [self.roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        self.roots = stash(components(reduce(DataFrame.unionByName, [self.links[-1], *known])), "roots")

    def rooted(self, rows: DataFrame) -> DataFrame:
        """rows (key, node, n) with the root of each node and a rank by a hash, another one in each group."""
        known = self.distinct.select("node", F.col("node").alias("root")) if self.roots is None else self.roots
        return rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("rank", F.xxhash64("node", "key"))

    def by_links(self, rows: DataFrame) -> DataFrame:
        """rows with the number of links as rank, most first."""
        if not self.links:
            return rows
        ends = reduce(DataFrame.unionByName, self.links).select(F.explode(F.array("a", "b")).alias("node"))
        return rows.join(ends.groupBy("node").agg((-F.count("*")).alias("degree")), "node", "left").withColumn("rank", F.coalesce("degree", F.lit(0))).drop("degree")

    def meet(self, rows: DataFrame) -> DataFrame:
        """Compare within the groups of rows (key, node, n, root, rank); rows (key, node, n) of large groups still apart are returned.

        Each with the hub of its group first, which settles families of near
        copies. Then, in groups still apart, all pairs of the small ones and
        each of a large one with its most linked member.
        """
        groups = stash(_groups(rows), "groups")
        self.add(_stars(rows, groups))
        met = stash(among(rows.select("key", "node", "n"), groups.select("key"), "key"), "met")
        rows = self.by_links(self.apart(met))
        groups = stash(_groups(rows), "groups")
        large = groups.where(F.col("size") > FEW)
        self.add(_small_groups(rows, large).unionByName(_stars(rows, large)))
        return self.apart(among(met, large.select("key"), "key"))

    def apart(self, many: DataFrame) -> DataFrame:
        """Those of many (key, node, n) whose group is still in different components."""
        rows = self.rooted(many)
        return stash(among(rows, stash(_groups(rows).select("key"), "open"), "key"), "apart")

    def may_link(self, left: DataFrame) -> DataFrame:
        """Those nodes of left that enough of the others' shingles are in.

        A set that is similar to another has four fifths of its own in common with
        it. Whatever left still has to be linked with each other is in it, so a
        set of which more than a fifth is in no other set of left is done.
        """
        sets = stash(self.sets_of(stash(left.select("node").distinct(), "asked")), "open")
        lone = sets.select("node", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("sets"), F.min("node").alias("node")).where("sets = 1")
        own = lone.groupBy("node").agg(F.count("*").alias("own"))
        sized = sets.select("node", F.size("set").alias("n")).join(own, "node", "left").fillna(0, ["own"])
        return stash(sized.where((F.col("n") - F.col("own")) * SIMILAR[1] >= F.col("n") * SIMILAR[0]).select("node"), "may")

    def differences(self, left: DataFrame) -> DataFrame:
        """(key, node, n, far, apart, odd) of the nodes of left (key, node, n): key is the family, apart what a set and the shingles that over half of its family have don't share.

        A family is what shares keys, over others too. far is EACH times the size
        of apart less ROOM * n: of sets x and y with k elements of apart in
        common the symmetric difference has as many as both have, less 2 * k,
        so they are similar if x.far + y.far is 2 * EACH * k at most.
        """
        first = left.groupBy("key").agg(F.min("node").alias("b"))
        family = stash(components(left.select("key", F.col("node").alias("a")).join(first, "key").select("a", "b").distinct()), "family")
        sets = self.sets_of(family.select("node")).join(family.withColumnRenamed("root", "key"), "node")
        sets = stash(sets.select("key", "node", "set"), "families")
        held = sets.select("key", F.explode("set").alias("s")).groupBy("key", "s").agg(F.count("*").alias("held"))
        members = stash(sets.groupBy("key").agg(F.count("*").alias("members")), "members")
        most = among(held, members, "key", "inner").where("2 * held > members").groupBy("key").agg(F.collect_list("s").alias("most"))
        both = sets.join(most, "key", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
        apart = both.select("key", "node", F.size("set").alias("n"), F.array_union(F.array_except("set", "most"), F.array_except("most", "set")).alias("apart"))
        with batches_of(apart.sparkSession, TEXTS):
            return stash(apart.withColumn("far", F.size("apart").cast("long") * EACH - F.col("n").cast("long") * ROOM).withColumn("odd", _parities("apart")), "differences")

    def settle(self, left: DataFrame) -> None:
        """Link what there is left to link within the groups of left (key, node, n).

        Sets x and y with x.far + y.far of 0 or less are similar, and so is each
        of them to the least far one of their family. All others have to have
        k >= (x.far + y.far) / (2 * EACH) differences in common, so the rarest
        one of these has k - 1 more behind it in either's list, by frequency.
        Parities then rule out nearly all pairs that are too far apart.
        """
        found = self.differences(left)
        rows = stash(self.rooted(found.select("key", "node", "n", "far")), "rows")
        least = stash(rows.groupBy("key").agg(F.min(F.struct("far", "node", "root")).alias("least")), "least")
        near = among(rows, least, "key", "inner").where("far + least.far <= 0 and root <> least.root")
        self.add(near.select(F.greatest("node", "least.node").alias("a"), F.least("node", "least.node").alias("b")))
        rows = self.apart(found.select("key", "node", "n"))
        each = stash(among(found, rows.select("node"), "node").select("key", "node", F.explode("apart").alias("s")), "each")
        shared = each.join(each.groupBy("key", "s").agg(F.count("*").alias("sets")).where("sets > 1"), ["key", "s"])
        lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "s"))).alias("list"))
        lists = rows.join(found.select("node", "far", "odd"), "node").join(lists, "node").select("key", "node", "n", "root", "far", "odd", F.size("list").alias("size"), F.posexplode("list").alias("at", "one"))
        places = stash(lists.select("key", F.col("one.s").alias("s"), "node", "n", "root", "far", "odd", (F.col("size") - F.col("at")).alias("behind")), "places")
        names = {"node": "b", "n": "m", "root": "of", "far": "less", "odd": "others", "behind": "rest"}
        met = places.join(places.where(F.col("far") <= EACH * F.col("behind")).withColumnsRenamed(names), ["key", "s"]).where("root <> of and far + less > 0 and (far > less or (far = less and node > b))")
        differ = F.aggregate(F.zip_with("odd", "others", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        met = met.where((F.col("far") + F.col("less") <= 2 * EACH * F.least("behind", "rest")) & (differ * EACH <= (F.col("n") + F.col("m")) * ROOM))
        self.add(met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")))

    def run(self) -> DataFrame | None:
        """(node, root) of every node with a link, None without any."""
        coarse = self.distinct.select("node", "n", F.explode(_bands("sig")).alias("key")).withColumn("root", F.col("node")).withColumn("rank", F.xxhash64("node", "key"))
        left = self.meet(coarse)
        if not left.isEmpty():
            left = stash(self.apart(among(left.select("key", "node", "n"), self.may_link(left), "node")), "left")
        if not left.isEmpty():
            self.settle(left)
        return self.roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Texts are linked from four fifths of common four-word shingles; fewer words
    are one shingle, and null, empty and blank texts have none and no link.
    component_id is the least id reachable over links, the row's own included; a
    null id never is the least one, and a component of null ids only has a null
    component_id. A row is kept if its id is that of its component, nulls being
    equal. Repeated rows stay repeated; an empty table gives an empty result;
    other columns, whatever their names, are not looked at.

    Equal sets of shingles are one point, so copies of a text travel as one row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("copy", F.unhex(F.md5(F.col("text").cast("binary"))))
    with batches_of(docs.sparkSession, TEXTS):
        prints = stash(rows.select("id", "copy", _sketch("text").alias("made")).select("id", "copy", "made.*"), "prints")
    some = prints.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.min(F.struct("copy", "n", "sig")).alias("one")).select("key", "least", "one.*")
    distinct = stash(some.withColumn("node", F.monotonically_increasing_id()), "distinct")
    roots = _Search(rows.select("copy", "text"), distinct).run()
    rooted = distinct.select("key", "least", "node")
    rooted = rooted.withColumn("root", F.col("node")) if roots is None else rooted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stash(rooted.join(least, "root").select("key", "component_id"), "components")
    named = prints.where("n > 0").select("id", "n", "key").join(names, "key").select("id", "n", "component_id")
    alone = prints.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: All pairs that share a shingle, and all that is reachable from a text.
OP11_SQL = r"""with recursive worded as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
  select doc_id, case when len(w) = 0 then []
    else list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) end as s
  from worded),
points as materialized (select s, min(doc_id) as least, len(s) as n, row_number() over () as p from sets where len(s) > 0 group by s),
keys as materialized (select p, n, unnest(s) as k from points),
links as materialized (
  select a.p as a, b.p as b from keys a join keys b on a.k = b.k and a.p <> b.p
  group by a.p, b.p having 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
reach(a, b) as (select p, p from points union select r.a, l.b from reach r join links l on l.a = r.b),
roots as materialized (select r.a as p, min(q.least) as component_id from reach r join points q on q.p = r.b group by r.a)
select doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from sets left join points using (s) left join roots using (p)"""

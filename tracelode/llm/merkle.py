"""A manifest of a dataset as a Merkle tree of sixteen-fold nodes, a subtree a source.

Rows are numbered within their source over range partitions, so no task holds a
source. Aligned blocks of leaves are subtrees of their own: one pass reduces each
block to its root, the roots are leaves of the next tree up, and so on to the
subroots and the root. A second pass walks every block leaf by leaf and carries
the authentication path along (Merkle traversal): for each height a stack of
open nodes reads one leaf a step, just so far ahead that the next run of
siblings is complete when the walk enters it. The walk holds a few runs for each
height besides its block; the path above is the same for the whole block and appended.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, documents, stash

#: Children of a node, and heights that a block of leaves climbs at most, so that it has FAN ** HEIGHT leaves.
FAN, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Stack:
    """Treehash: nodes pushed in order; FAN of a height become one of the next, up to ``height``, where they are collected."""

    def __init__(self, height: int):
        self.open: list[list[str]] = [[] for _ in range(height)]
        self.done: list[str] = []

    def push(self, node: str) -> None:
        for run in self.open:
            run.append(node)
            if len(run) < FAN:
                return
            node = digest(run)
            run.clear()
        self.done.append(node)

    def take(self) -> list[str]:
        """The collected nodes, short runs below closed; the stack is empty then."""
        above: list[str] = []
        for run in self.open:
            run += above
            above = [digest(run)] if run else []
            run.clear()
        found, self.done = self.done + above, []
        return found


def levels(nodes: int, most: int = HEIGHT) -> int:
    """Heights that a block of a tree of so many nodes climbs: ``most``, or less if one node is left before."""
    height = 0
    while nodes > 1 and height < most:
        nodes, height = -(-nodes // FAN), height + 1
    return height


def root_of(nodes: Iterable[str], height: int) -> str:
    stack = Stack(height)
    for node in nodes:
        stack.push(node)
    return stack.take()[0]


def walk(leaves: list[str], height: int) -> Iterator[list[str]]:
    """The path of each leaf of a block: for each height what stands left of its node in the run, and what right.

    Before the walk, every height's first run is built. From then on a height
    reads one leaf a step, its own run's length ahead.
    """
    size = [FAN ** (h + 1) for h in range(height)]
    runs, ahead = [], [Stack(h) for h in range(height)]
    for h in range(height):
        for leaf in leaves[: size[h]]:
            ahead[h].push(leaf)
        runs.append(ahead[h].take())
    for i in range(len(leaves)):
        path = []
        for h, run in enumerate(runs):
            own = i * FAN // size[h] % FAN
            path += ["".join(run[:own]), "".join(run[own + 1 :])]
        yield path
        for h in range(height):
            if (k := i + size[h]) < len(leaves):
                ahead[h].push(leaves[k])
            if (i + 1) % size[h] == 0:
                runs[h] = ahead[h].take()


def fold(node: str, path: list[str]) -> str:
    """The root over a node, by its path."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = digest((left, node, right))
    return node


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with ``at``, their place within their tree by the order, nulls first, and ``total``, the tree's number of rows.

    rows are read twice, once for the ranges. They are dealt out by ranges of tree
    and order, and then by where they were read, so that a tree or a run of equal rows of any size is spread. The place is that
    within the partition plus what partitions before hold of the tree.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order, "read")]
    ranged = rows.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    # The upper bits of such an id name the partition, the lower 33 count its rows.
    placed = stash(ranged.drop("read").withColumn("mark", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("mark", 33)), "placed")
    slices = placed.groupBy(tree, "slice").agg(F.count("*").alias("n"), F.min("mark").alias("first"))
    of_tree = W.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(of_tree.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stash(slices.select(tree, "slice", (before - F.col("first")).alias("shift"), F.sum("n").over(of_tree).alias("total")), "starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    return placed.join(starts, [tree, "slice"]).withColumn("at", F.col("mark") + F.col("shift")).drop("mark", "shift", "slice")


def _block(height: int) -> Column:
    return F.expr(f"at div {FAN**height}")


def block_paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, block, path, root): for each block of nodes (tree, at, total, node) the path above its root, and the tree's root."""

    def reduced(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        first, total = rows.iloc[0], int(rows["total"].iat[0])
        return pd.DataFrame({"tree": [first["tree"]], "at": [first["block"]], "total": [-(-total // FAN**height)], "node": [root_of(rows["node"], levels(total, height))]})

    blocks = nodes.select("tree", "at", "total", "node", _block(height).alias("block")).groupBy("tree", "block")
    roots = stash(blocks.applyInPandas(reduced, "tree string, at long, total long, node string"), "blocks")
    if (roots.agg(F.max("total")).first()[0] or 0) <= 1:
        return roots.select("tree", F.col("at").alias("block"), F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    return node_paths(roots, height).withColumnRenamed("at", "block")


def node_paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, at, path, root) for every node (tree, at, total, node)."""

    def walked(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at", ignore_index=True)
        if not len(nodes):
            return pd.DataFrame({"tree": [], "at": [], "path": [], "root": []})
        shared = list(above["path"].iat[0])
        paths = [path + shared for path in walk(nodes["node"].tolist(), levels(int(nodes["total"].iat[0]), height))]
        return nodes[["tree", "at"]].assign(path=paths, root=above["root"].iat[0])

    own = nodes.withColumn("block", _block(height)).groupBy("tree", "block")
    return stash(own.cogroup(block_paths(nodes, height).groupBy("tree", "block")).applyInPandas(walked, "tree string, at long, path array<string>, root string"), "paths")


def proofs(leaves: DataFrame, above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest's rows, of leaves (id, tree, at, total, node, now) and what is above their blocks (tree, block, path, subroot, root)."""

    def proved(leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("at", ignore_index=True)
        out = []
        if len(leaves):
            shared, subroot, root = list(above["path"].iat[0]), above["subroot"].iat[0], above["root"].iat[0]
            paths = walk(leaves["node"].tolist(), levels(int(leaves["total"].iat[0]), height))
            for leaf, now, path in zip(leaves["node"].tolist(), leaves["now"].tolist(), paths, strict=True):
                path += shared
                folded = fold(now, path)
                out.append((leaf, subroot, root, digest(path), folded, folded == root))
        made = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return pd.concat([leaves["id"].astype("Int64"), made], axis=1)

    blocks = leaves.withColumn("block", _block(height)).groupBy("tree", "block")
    return blocks.cogroup(above.groupBy("tree", "block")).applyInPandas(proved, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def leaf_of(fields: Iterable[Column]) -> Column:
    """The digest of fields as length and value, a null as a dash."""
    told = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def manifest(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Leaves of a source stand by id, a null id first and equal ids by their leaf;
    sources by their bytes, a null source first. Where ``tampered`` holds, the
    row is taken to have had A-Z of its text lower-cased since: folded_root comes
    from that leaf and the original siblings. Nulls, empty and very long texts
    are fields like others, repeated rows are leaves each; an empty table gives
    an empty result, and columns that are no field are not looked at.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in fields]
    tree = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    leaf = leaf_of(F.col(c) for c in fields)
    read = rows.select(F.col(id_col).cast("long").alias("id"), tree.alias("tree"), leaf.alias("node"), F.when(tampered, leaf_of(changed)).otherwise(leaf).alias("now"))
    leaves = stash(numbered(stash(read, "digests"), "tree", ["id", "node"]), "leaves")
    blocks = stash(block_paths(leaves, height), "above")
    subroots = numbered(blocks.where("block = 0").select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("root").alias("node")), "tree", ["name"])
    subroots = stash(subroots, "subroots")
    tops = subroots.join(node_paths(subroots, height).select("at", F.col("path").alias("top"), F.col("root").alias("all")), "at").select(F.col("name").alias("tree"), "top", "all")
    tops = F.broadcast(tops) if subroots.count() <= BROADCAST_ROWS // 100 else tops
    above = blocks.join(tops, "tree").select("tree", "block", F.concat("path", "top").alias("path"), F.col("root").alias("subroot"), F.col("all").alias("root"))
    return proofs(leaves, above, height).withColumnRenamed("id", id_col)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def _sql(height: int = 6) -> str:
    """The trees level by level, for sources of up to 16 ** height rows."""
    told = lambda c: f"case when {c} is null then '-' else concat(octet_length(encode(cast({c} as varchar))), ':', cast({c} as varchar)) end"
    leaf = lambda text: "sha256(" + " || ".join(told(text if c == "text" else c) for c in FIELDS) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

    def tree(name: str) -> str:
        """name0 (tree, pos, node) up to name{height}; and for each node of name0 its path by level."""
        return ",\n".join(
            f"""{name}{k + 1} as materialized (
  select tree, pos // 16 as pos, case when max(n) > 1 then sha256(string_agg(node, '' order by pos)) else max(node) end as node
  from (select *, count(*) over (partition by tree) as n from {name}{k}) group by tree, pos // 16),
{name}p{k} as materialized (
  select b.tree, b.pos, coalesce(string_agg(s.node, '' order by s.pos) filter (s.pos < o.pos), '') as l,
    coalesce(string_agg(s.node, '' order by s.pos) filter (s.pos > o.pos), '') as r, max(o.n) > 1 as more
  from {name}0 b join (select *, count(*) over (partition by tree) as n from {name}{k}) o on o.tree = b.tree and o.pos = b.pos // {16**k}
    join {name}{k} s on s.tree = b.tree and s.pos // 16 = o.pos // 16
  group by b.tree, b.pos)"""
            for k in range(height)
        )

    def up(name: str) -> str:
        """Of each node of name0 what stands left and right of it by level."""
        return ", ".join(f"p{k}.l as l{k}, p{k}.r as r{k}, p{k}.more as m{k}" for k in range(height)), " ".join(f"join {name}p{k} p{k} using (tree, pos)" for k in range(height))

    low, lowjoin = up("d")
    top, topjoin = up("s")
    steps = [(side, k) for side in ("low", "top") for k in range(height)]
    folds = ",\n".join(f"f{i + 1} as materialized (select * replace (case when {s}.m{k} then sha256({s}.l{k} || now || {s}.r{k}) else now end as now) from f{i})" for i, (s, k) in enumerate(steps))
    proof = " || ".join(f"{s}.l{k} || {s}.r{k}" for s, k in steps)
    return f"""with d as materialized (
  select doc_id, case when source is null then '' else '=' || source end as tree, {leaf("text")} as node,
    case when {crc} % 5 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} else {leaf("text")} end as now
  from documents),
placed as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, node) - 1 as pos from d),
d0 as materialized (select tree, pos, node from placed),
{tree("d")},
s0 as materialized (select '' as tree, row_number() over (order by encode(tree)) - 1 as pos, node, tree as name from d{height}),
{tree("s")},
low as materialized (select d0.tree, d0.pos, {low} from d0 {lowjoin}),
top as materialized (select s0.name, s0.node as subroot, (select node from s{height}) as root, {top} from s0 {topjoin}),
f0 as materialized (
  select placed.doc_id, placed.node as leaf, placed.now, top.subroot, top.root, low, top
  from placed join low using (tree, pos) join top on top.name = placed.tree),
{folds}
select doc_id, leaf, subroot, root, sha256({proof}) as proof_sha256, now as folded_root, now = root as verified from f{len(steps)}"""


OP12_SQL = _sql()

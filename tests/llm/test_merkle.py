import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelode.llm import merkle as S

DATA = "/root/testdata/sf0.001"
H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def plain_paths(nodes):
    """(root, paths) of a list of nodes: level after level over the whole list."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, where):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            path += ["".join(run[: k % 16]), "".join(run[k % 16 + 1 :])]
        nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        where = [k // 16 for k in where]
    return (nodes or [None])[0], paths


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(docs):
    """Of rows (doc_id, source, lang, n_chars, text) the whole manifest."""
    by = {}
    for row in docs:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    held = {s: plain_paths([leaf(r) for r in trees[s]]) for s in sources}
    root, tops = plain_paths([held[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for row, path in zip(trees[s], held[s][1]):
            path, now = path + top, leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                now = leaf((*row[:4], lowered(row[4])))
            for a, b in zip(path[::2], path[1::2]):
                now = H(a, now, b)
            out.append((row[0], leaf(row), held[s][0], root, H(*path), now, now == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 300, 4095, 4096])
def test_walk_equals_paths_level_by_level(n):
    nodes = [H(str(i)) for i in range(n)]
    root, paths = plain_paths(nodes)
    assert list(S.walk(nodes, S.levels(n))) == paths and S.root_of(nodes, S.levels(n)) == root
    assert all(S.fold(nodes[i], paths[i]) == root for i in range(0, n, 7))


def test_walk_keeps_a_few_runs_for_each_height():
    walk = S.walk([H(str(i)) for i in range(4096)], 3)
    for _ in range(2000):
        next(walk)
    held = sum(len(r) for r in walk.gi_frame.f_locals["runs"]) + sum(len(s.done) + sum(map(len, s.open)) for s in walk.gi_frame.f_locals["ahead"])
    assert held <= 3 * 2 * 16 + 3 * 16


def table(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, source string, lang string, n_chars long, text string, at long, tree string, node string")
    return df.repartition(7)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def same(got, want):
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("height", [1, 3])
def test_equals_a_plain_tree(spark, height):
    """With blocks of one run, trees of blocks stand on trees of blocks."""
    rng = random.Random(7)
    names = [None, "", "=", "hot", "hot", "hot", "hot", "é", "z", *[f"s{i}" for i in range(40)]]
    docs = [(i, rng.choice(names), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([None, "", f"Some Text {i} ÄÉ", "lower"])) for i in range(1_000)]
    docs += [(5, "hot", "en", 1, "Again")] * 300 + [(None, "hot", None, None, None)] * 3 + [(None, None, None, None, "X")] + [(2_000, "long", "en", 1, "Long Text " * 100_000)]
    same(S.manifest(table(spark, docs), tampered=tampered(), height=height).collect(), plain(docs))


def test_one_row_and_an_empty_table(spark):
    one = [(3, "a", None, 1, "T")]
    got = S.manifest(table(spark, one)).collect()
    same(got, [(3, leaf(one[0]), leaf(one[0]), leaf(one[0]), H(), leaf(one[0]), True)])
    assert S.manifest(table(spark, [])).count() == 0


def test_a_source_of_several_blocks_and_many_sources(spark):
    docs = [(i, "big" if i < 9_000 else f"s{i % 5_000}", None, None, str(i)) for i in range(14_000)]
    same(S.manifest(table(spark, docs), tampered=tampered()).collect(), plain(docs))


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    found = con.execute(S.OP12_SQL)
    names = [c[0] for c in found.description]
    got = S.op12_merkle(spark, DATA)
    assert sorted(got.columns) == sorted(names)
    same(got.select(*names).collect(), found.fetchall())

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tracelode.llm import codebooks as S

DATA = "/root/testdata/sf0.001"


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 5, 8, 16, 40):
        for spread in (2, 50, 5_000):
            x, e = rng.integers(-spread, spread, (300, width)), rng.integers(-spread, spread, (16, width))
            e[5] = e[2]
            x[:20] = e[rng.integers(0, 16, 20)]
            far = ((x[:, None] - e[None]) ** 2).sum(axis=2)
            index, d = S.nearest(x, e)
            assert (index == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()


def test_bounds_are_never_above_the_distance_and_tighten():
    rng = np.random.default_rng(4)
    x, e = rng.integers(-4_000, 4_000, (500, 16)), rng.integers(-4_000, 4_000, (16, 16))
    e[0] = x[0] + 1  # the bound of one block equals the distance
    far, means = ((x[:, None] - e[None]) ** 2).sum(axis=2), []
    for begin in S.segments(16):
        (s, r, n), (s2, r2, _) = S.outline(x, begin), S.outline(e, begin)
        low = S.bound(s[:, None], r[:, None], s2[None], r2[None], n)
        assert (low <= far).all()
        means.append(low.mean())
    assert means == sorted(means) and len(means) == 4


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes of (id, vector, label) of one width, by Python's whole numbers."""
    kept = [(i, [max(-S.EDGE, min(S.EDGE, math.floor(4096 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return min(range(len(far)), key=far.__getitem__), min(far)

    for _ in range(rounds):
        for p in range(parts):
            to = [near(v, p)[0] for _, v, _ in kept]
            for e in range(len(books[p])):
                if some := [cut(v, p) for (_, v, _), t in zip(kept, to) if t == e]:
                    books[p][e] = [sum(x) // len(some) for x in zip(*some)]
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        error = sum(d for _, d in found)
        out.append((i, "".join(f"{c:02x}" for c, _ in found), error if error < 1 << 63 else None, label, name))
    total = {label: sum(r[2] or 0 for r in out if r[3] == label) for *_, label, _ in out}
    return [(i, c, e, total[label], name) for i, c, e, label, name in out]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<float>, label int, vec double, ints string")


def test_nulls_repeats_ties_and_wide_numbers(spark):
    rng = random.Random(5)
    vec = lambda: [rng.choice([0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(16)]
    rows = [(i, vec(), rng.choice([None, 0, 1])) for i in range(200)]
    rows += [(7, rows[3][1], 2), (7, rows[3][1], 2), (None, vec(), None), (None, rows[9][1], 3)]
    rows += [(300, [60_000.0] * 16, 1), (301, [-3e38] + [0.0] * 15, 1), (302, [1e9] * 16, 4), (303, [1e9] * 15 + [1e9 + 64], 4)]
    rows = [(i, None if v is None else np.float32(v).tolist(), label) for i, v, label in rows]
    out = [(400, None, 1), (401, [None] + [0.0] * 15, 1), (402, [math.nan] * 16, 1), (403, [math.inf] + [0.0] * 15, 2)]
    got = S.compress(table(spark, rows + out)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_few_rows_other_widths_and_an_empty_table(spark):
    rows = [(i, [float(i), *[0.5] * 7], 0) for i in range(5)]
    others = [(10 + i, [1.0 * i] * 16, 1) for i in range(3)]
    got = {r.vec_id: r for r in S.compress(table(spark, rows + others + [(20, [1.0] * 9, 1), (21, [], 2)])).collect()}
    for some in (rows, others):
        for i, code, error, _, name in plain(some):
            assert (got[i].code, got[i].error, got[i].codebooks_sha256) == (code, error, name)
    assert got[20].code is None and got[20].error is None and got[21].code == "00" * 8 and got[21].error == 0
    empty = S.compress(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    found = con.execute(S.OP13_SQL)
    names = [c[0] for c in found.description]
    got = S.op13_codebooks(spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8])
def test_blocks_cover_a_part(width):
    for begin in S.segments(width):
        assert begin[0] == 0 and (np.diff(begin) > 0).all() and begin[-1] < width

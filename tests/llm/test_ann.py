import heapq

import numpy as np

from tracelode.llm import ann as A


def brute(rows, every, k):
    rows = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in rows:
        if q % every == 0:
            cos = [(-float(rows[q] @ v / np.sqrt((rows[q] @ rows[q]) * (v @ v))), i) for i, v in rows.items() if i != q]
            out[q] = [(i, -c) for c, i in heapq.nsmallest(k, cos)]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 50, 5)
    got = found(A.nearest(vectors))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, w in want.items():
        scores = dict(w)
        for i, s in got[q]:
            assert i not in scores or abs(scores[i] - s) < 1e-12


def test_all_cells_give_the_exact_answer_with_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, (2 * np.array(rows[0][1])).tolist()), (-50, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cell int, block int")
    got, want = found(A.nearest(df, every=50, share=1.0)), brute(rows, 50, 5)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert np.allclose([s for _, s in got[q]], [s for _, s in w])
        assert [i for i, _ in got[q]] == [i for i, _ in w] or len({round(s, 12) for _, s in w}) < 5


def test_parts_of_the_queries_change_nothing(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 10, 5)
    whole, parts = found(A.nearest(vectors, every=10)), found(A.nearest(vectors, every=10, together=7))
    assert whole == parts and recall(whole, want) >= 0.9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1e-300, 1e-300]), (9, [1e300, 0.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    got = found(A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [i for i, _ in got[0]] == [9, 8] and len(got) == 1
    assert A.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_walk_goes_by_the_sum_of_distances():
    rng = np.random.default_rng(1)
    a, b, sizes = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
    order = list(A.walk(a, b, sizes, 10**9))
    cost = [a[i] + b[j] for i, j in order]
    assert cost == sorted(cost) and set(order) == set(zip(*np.nonzero(sizes), strict=True))
    assert sum(sizes[c] for c in A.walk(a, b, sizes, 9)) >= 9


def test_blocks_hold_whole_small_cells_and_split_large_ones():
    first, parts = A.deal(np.array([3, 4, 20, 0, 5, 6, 10]), 10)
    assert first == [0, 0, 1, 3, 3, 4, 5] and parts == [1, 1, 2, 1, 1, 1, 1]

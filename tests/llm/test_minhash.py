import random
from math import comb

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tracelode.llm import minhash as S

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, min(1, len(words))))}


def plain(docs):
    """(n, component) of each row, by all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 4 * max(len(x), len(sets[j])) <= 5 * min(len(x), len(sets[j])):
                same = len(x & sets[j])
                if 100 * same >= 80 * (len(x) + len(sets[j]) - same):
                    root[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(docs):
        if name is not None:
            least[top(i)] = min(name, least.get(top(i), name))
    return [(name, len(s), least.get(top(i)), name == least.get(top(i))) for i, ((name, _), s) in enumerate(zip(docs, sets))]


def check(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, key int, n string").repartition(5)
    got = S.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda r: tuple(map(repr, r))
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(plain(docs), key=key)
    assert got == want
    return want


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def test_posterior_bounds_keep_pairs_at_the_threshold():
    for n, m in S.least_matches(128):
        below = sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m))
        assert below < S.MISS <= below + comb(n + 1, m) * 0.8**m * 0.2 ** (n + 1 - m)
    assert S.least_matches(128)[-1][1] > 70
    x = np.zeros((3, 128), np.uint16)
    y = x.copy()
    y[1, :100] = 1  # 28 of 128
    y[2, 110:] = 1  # 110 of 128
    assert S.likely(x, y, S.least_matches(128)).tolist() == [True, False, True]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 2_000).astype(np.uint64)
    other = np.concatenate([base[:1_600], rng.integers(0, 1 << 63, 400).astype(np.uint64)])
    same = (S.signature(base, 2_048) == S.signature(other, 2_048)).mean()
    assert abs(same - 1_600 / 2_400) < 0.05


def test_equals_all_pairs_around_the_threshold(spark):
    rng = random.Random(11)
    docs = []
    for family in range(60):
        base = words(rng, rng.choice([4, 8, 20, 60, 200]))
        for _ in range(6):
            docs.append((len(docs) * 3 % 1_000, " ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])))))
    docs += [(None, docs[0][1]), (None, None), (5_000, None), (5_001, ""), (5_002, " \t\n"), (5_003, "one"), (5_004, "ONE"), (5_005, "one two"), (None, "quite alone it is"), (None, "quite alone it is")]
    docs += [docs[7]] * 3 + [(6_000, docs[9][1].upper()), (6_001, docs[9][1].replace(" ", " ")), (6_002, docs[9][1].replace(" ", "\x0b "))]
    found = check(spark, docs)
    assert len({r[2] for r in found}) > 60


def test_a_large_family_and_a_shared_passage(spark):
    """Copies that are near to their original alone, chains of copies, and unlike texts that share a long passage."""
    rng = random.Random(12)
    base = words(rng, 120)
    docs = [(100 + i, " ".join(edited(rng, base, 3))) for i in range(250)] + [(1_000, " ".join(base))]
    chain = words(rng, 150)
    for i in range(80):
        chain = edited(rng, chain, 2)
        docs.append((2_000 + i, " ".join(chain)))
    passage = words(rng, 100)
    docs += [(3_000 + i, " ".join(passage + words(rng, 30))) for i in range(150)]
    docs += [(4_000 + i, " ".join(passage + words(rng, 22))) for i in range(60)]
    found = check(spark, docs)
    assert sum(r[2] == 100 for r in found) > 200


def test_a_family_of_edited_copies_is_not_written_out_in_pairs(spark, monkeypatch):
    """Most of its pairs are too near for bands to tell and too far to be links."""
    rng, made, add = random.Random(14), [], S._Search.add

    def counted(self, pairs):
        made.append(pairs.count())
        return add(self, pairs)

    monkeypatch.setattr(S._Search, "add", counted)
    base = words(rng, 150)
    docs = [(i, " ".join(edited(rng, base, rng.choice([2, 3, 4, 5, 6])))) for i in range(600)]
    found = check(spark, docs)
    assert len({r[2] for r in found}) > 200
    assert made[-1] < len(docs) and sum(made) < 70 * len(docs)


def test_differences_from_a_family_lose_no_link(spark, monkeypatch):
    """Everything as one family, without bands: near copies of several texts, of other lengths, in chains, and unlike texts."""
    rng = random.Random(15)

    def run(self):
        self.settle(self.distinct.select(F.lit(0).cast("long").alias("key"), "node", "n"))
        return self.roots

    monkeypatch.setattr(S._Search, "run", run)
    docs = []
    for size, copies in ((90, 60), (40, 20), (12, 15), (4, 6)):
        base = words(rng, size)
        for _ in range(copies):
            text = edited(rng, base, rng.randrange(1 + size // 15))
            docs.append((len(docs), " ".join(text[: rng.choice([size, size, size * 9 // 10, size * 8 // 10])])))
    chain = words(rng, 60)
    for _ in range(30):
        chain = edited(rng, chain, 1)
        docs.append((len(docs), " ".join(chain)))
    docs += [(len(docs) + i, " ".join(words(rng, 20))) for i in range(10)]
    found = check(spark, docs)
    assert 20 < len({r[2] for r in found}) < len(docs) - 20
    assert {r[2] for r in check(spark, [d for d in docs if d[0] < 60])} != set(range(60))


def test_empty_table_and_texts_without_words(spark):
    assert check(spark, []) == []
    assert [r[1:] for r in check(spark, [(1, None), (2, "")])] == [(0, 1, True), (0, 2, True)]


def test_a_very_long_text(spark):
    rng = random.Random(13)
    long = words(rng, 60_000)
    check(spark, [(1, " ".join(long)), (2, " ".join(edited(rng, long, 1_000))), (3, " ".join(edited(rng, long, 9_000))), (4, "x" * 300_000)])


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    found = con.execute(S.OP11_SQL)
    names = [c[0] for c in found.description]
    got = S.op11_minhash(spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())

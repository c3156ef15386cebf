import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import simhash as S


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    rows = [(i, f) for i, f in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if bin(rows[x][1] ^ rows[y][1]).count("1") <= 4:
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [least.get(find(x)) for x in range(len(rows))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBc \t\né ", max_size=60))
def test_fingerprint_follows_the_definition(text):
    assert S.fingerprint_of(text) % 2**64 == plain_print(text)


def test_long_text_is_counted_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdef") for _ in range(500))
    whole = S.fingerprint_of(text)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint_of(text) == whole


@pytest.mark.parametrize("bits, at_once", [(4, 1 << 21), (11, 1 << 21), (6, 3_000), (None, 1 << 21)])
def test_balls_lose_no_link(spark, monkeypatch, bits, at_once):
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    rng = random.Random(at_once + (bits or 0))
    points = [rng.getrandbits(64) for _ in range(12)]
    for p in list(points):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
            points.append(p)
    signed = [int(np.uint64(p).view(np.int64)) for p in set(points)]
    links = S.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits=bits).collect()
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 4 for r in links)
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    for x in signed:
        for y in signed:
            if bin((x ^ y) % 2**64).count("1") <= 4:
                assert find(x) == find(y)


def test_variants_of_a_class_are_taken_apart_without_loss(monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fp = [base]
    for _ in range(60):
        p = rng.choice(fp)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << b
        fp.append(p)
    fp = np.unique(np.array(fp, np.uint64))
    monkeypatch.setattr(S, "AT_ONCE", 5_000)
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in S._variants_met(fp, np.zeros(len(fp), np.int64), 64, 2):
        assert (np.bitwise_count(fp[a] ^ fp[b]) <= 4).all()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[find(x)] = find(y)
    for x in range(len(fp)):
        for y in range(x):
            if int(fp[x] ^ fp[y]).bit_count() <= 4:
                assert find(x) == find(y)


def test_rows_nulls_repeats_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200", "zz")
    rows = [(5, base, 1), (3, near, 2), (9, base.upper(), 3), (7, None, 4), (8, "", 5), (None, " \t", 6), (11, "alone", 7), (11, "alone", 7), (12, "other words here now", 8), (None, "nobody", 9)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, fp long, id long, component_id long")
    got = [(r[0], r[1] % 2**64, r[2]) for r in S.near_duplicates(docs).collect()]
    prints = [(i, plain_print(t)) for i, t, _ in rows]
    want = [(i, f, c) for (i, f), c in zip(prints, plain_components(prints), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_one_row_of_each_component(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(4, base, "x"), (2, base, "y"), (6, base.replace("w7 ", "q "), "z"), (9, "alone", "a"), (9, "alone", "a")], "doc_id long, text string, source string")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id", "source").collect()) == [(2, "y"), (9, "a")]


def test_given_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = np.array([plain_print(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.array([r.doc_id for r in rows])
    while True:
        after = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (after == label).all():
            break
        label = after
    got = {r[0]: r[2] for r in S.near_duplicates(docs).collect()}
    assert got == {r.doc_id: int(c) for r, c in zip(rows, label, strict=True)}


def test_copies_at_four_fifths_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (_, text) in enumerate(rows[:40]):
        w = (text or "").split()
        if len(w) > 60:
            w[len(w) // 2] = "changed"
            rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, "  "), (20_003, "two words"), (20_004, "TWO words"), (20_005, rng.random().hex())]
    sets = [set(S.shingle_set(t).tolist()) for _, t in rows]
    label = np.array([i for i, _ in rows])
    near = np.array([[a == b or 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    while (after := np.where(near, label[None, :], 1 << 60).min(axis=1)).tolist() != label.tolist():
        label = after
    got = dict(S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: int(c) for (i, _), c in zip(rows, label, strict=True)}


def test_copies_of_an_empty_table(spark):
    assert S.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0

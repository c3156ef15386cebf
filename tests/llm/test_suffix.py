import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracelode.llm import suffix as S
from tracelode.llm.windows import anchors, digits


def plain(texts, depth):
    seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        spans = int(((~gone[:-1]) & gone[1:]).sum() + gone[0]) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(20)
    rows = [text(rng.randint(0, 60)) for _ in range(25)]
    for _ in range(25):
        base = rng.choice(rows).split(" ")
        if len(base) > 3:
            base[rng.randrange(len(base))] = word()
        rows.append(" ".join(base))
    rows += [text(5) + passage + text(rng.randint(0, 5)) for _ in range(12)]
    rows += [rows[3], rows[3], "a" * 150, "ab" * 90, passage[:40], None, "", passage * 3]
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 20_000), (2, 20_000), (3, 2)])
def test_against_counting_every_window(spark, seed, most):
    rows = corpus(seed)
    docs = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, k1 int, data string")
    got = S.without_repeats(docs, depth=48, gram=16, most=most).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    want = plain([(t or "").encode() for t in rows], 48)
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(rows))]
    assert mine == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=str)


def test_anchors_hang_on_the_window_alone(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abc") for _ in range(3000))
    first, last, place, _ = anchors(data, 100, 32)
    assert first[0] == 0 and last[-1] == 2900 and (first[1:] == last[:-1] + 1).all()
    at = {w: p - w for a, b, p in zip(first.tolist(), last.tolist(), place.tolist()) for w in range(a, b + 1)}
    for w in range(0, 2900, 37):
        f, _, p, _ = anchors(data[w : w + 100], 100, 32)
        assert p[0] - f[0] == at[w]
    monkeypatch.setattr("tracelode.llm.windows.BLOCK", 500)
    f2, l2, p2, _ = anchors(data, 100, 32)
    assert {w: p - w for a, b, p in zip(f2.tolist(), l2.tolist(), p2.tolist()) for w in range(a, b + 1)} == at


def test_equal_digests_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "digits", lambda data, size: digits(data, size) & np.uint64(0))
    runs = [b"abcdefgh", b"abcdefgX", b"abcdefgh", b"Zbcdefgh"]
    got = S.repeated(np.zeros(4, np.int64), np.zeros(4, np.int64), runs, 8, 4)
    assert got.tolist() == [True, False, True, False]


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_table_at_full_depth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    got = {r[0]: tuple(r[1:]) for r in S.op2_suffix(spark, "/root/testdata/sf0.001").collect()}
    data = list(texts.values())
    assert got == dict(zip(texts, plain(data, 400), strict=True))


def test_a_text_of_a_megabyte(spark):
    rng = random.Random(10)
    long = "".join(rng.choices("abcdefghij klmnop", k=1_000_000))
    other = "".join(rng.choices("abcdefghij klmnop", k=2_000))
    rows = [(1, long), (2, other + long[400_000:401_000]), (3, long[999_600:] + other[:399]), (4, other[:500])]
    got = {r.doc_id: (r.n_bytes, list(r.spans)) for r in S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1_000_000, [400_000, 401_000, 999_600, 1_000_000]), 2: (3_000, [0, 500, 2_000, 3_000]), 3: (799, [0, 400]), 4: (500, [0, 500])}


def test_bytes_in_repeated_passages(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(300)
    rows = [(1, text(200) + passage + text(90)), (2, text(33) + passage), (3, text(900)), (4, None), (5, passage[:200] + text(100)), (6, text(100) + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (len(r.spans), r.n_passage) for r in S.without_repeats(docs, passage=256).collect()}
    data = {i: (t or "").encode() for i, t in rows}
    count = {}
    for d in data.values():
        for k in range(len(d) - 255):
            count[d[k : k + 256]] = count.get(d[k : k + 256], 0) + 1
    want = {i: len({b for k in range(len(d) - 255) if count[d[k : k + 256]] > 1 for b in range(k, k + 256)}) for i, d in data.items()}
    assert got == {i: (0, n) for i, n in want.items()} and want[1] >= 300 and want[5] == 0


def test_removal_is_the_same_beside_a_search_for_passages(spark):
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(corpus(4))], "doc_id long, text string")
    both, alone = S.without_repeats(docs, depth=48, gram=16, passage=32).collect(), S.without_repeats(docs, depth=48, gram=16).collect()
    assert sorted((r[:4] for r in both), key=str) == sorted((r[:4] for r in alone), key=str)
    assert any(r.spans for r in both) and any(r.n_passage and not r.spans for r in both)


def test_query_tells_passages_of_over_fifty_words_below_its_depth(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = text(52)
    rows = [(1, f"{text(90)} {passage} {text(20)}"), (2, f"{passage} {text(70)}"), (3, text(150)), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_passage) for r in S.op2_suffix(spark, str(tmp_path)).collect()}
    assert got[3] == got[4] == (0, 0)
    assert all(got[i][0] == 0 and got[i][1] >= len(passage) for i in (1, 2))

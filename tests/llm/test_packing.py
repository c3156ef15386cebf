import random
from collections import defaultdict

import numpy as np

from tracelode.llm import packing as S


def plain_fit(bins, size, source, cluster):
    fitting = [(room, k) for k, (room, sources, clusters) in enumerate(bins) if room >= size and source not in sources and cluster not in clusters]
    return min(fitting, default=(None, -1))[1]


def test_search_takes_the_tightest_compatible_bin(monkeypatch):
    monkeypatch.setattr(S, "STRIDE", 3)
    rng = random.Random(6)
    for _ in range(30):
        mine, bins = S.Bins(100, 70, 90, 200), []
        for _ in range(200):
            size, source, cluster = rng.randint(0, 60), rng.choice([-1, 0, rng.randrange(70)]), rng.choice([-1, rng.randrange(90)])
            k = plain_fit(bins, size, source if source >= 0 else None, cluster if cluster >= 0 else None)
            got, _ = mine.put(size, source, cluster)
            if k < 0:
                k = len(bins)
                bins.append([100, set(), set()])
            assert got == k
            bins[k][0] -= size
            bins[k][1] |= {source} - {-1}
            bins[k][2] |= {cluster} - {-1}


def check(got, docs, room):
    """All laws of a packing; the number of bins."""
    text = defaultdict(list)
    for i, t, s in docs:
        text[i].append((t, s))
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: (r.bin_start, r.n_tokens))
        at = 0
        for r in rows:
            assert r.bin_start == at
            at += r.n_tokens
        assert at <= room
        if all(len(text[r.doc_id]) == 1 for r in rows):
            sources = [s for r in rows if (s := text[r.doc_id][0][1]) is not None]
            same = [" ".join(t.lower().split()) for r in rows if (t := text[r.doc_id][0][0] or "").split()]
            assert len(set(sources)) == len(sources) and len(set(same)) == len(same)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.n_tokens))
    for i, rows in text.items():
        want = []
        for t, _ in rows:
            n = len((t or "").split())
            want += [(a, min(room, n - a)) for a in range(0, max(n, 1), room)]
        assert sorted(pieces[i]) == sorted(want)
    return len(bins)


def test_laws(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randint(0, 70)) + f" {i}", rng.choice(["hot", None, f"s{rng.randrange(9)}"])) for i in range(300)]
    docs += [(400 + i, docs[5][1].upper(), f"t{i}") for i in range(40)]
    docs += [(500, None, "a"), (501, "", "a"), (None, "some words", None), (502, "x " * 1000, "b"), (503, "rep", "c"), (503, "rep", "c")]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, source string, bin int, size int")
    for per_shard in (4096, 60):
        check(S.pack(df, room=64, per_shard=per_shard).collect(), docs, 64)


def test_as_many_bins_as_plain_best_fit(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{i}" for _ in range(n)), None) for i, n in enumerate(rng.integers(1, 60, 400).tolist())]
    bins = check(S.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), room=64).collect(), docs, 64)
    rooms = []
    for n in sorted((len(t.split()) for _, t, _ in docs), reverse=True):
        k = plain_fit([(r, set(), set()) for r in rooms], n, None, None)
        if k < 0:
            rooms.append(64 - n)
        else:
            rooms[k] -= n
    assert bins == len(rooms)


def test_empty_table(spark):
    assert S.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_a_very_long_text_is_packed_to_its_end(spark):
    docs = [(1, "word " * 200_000 + "end", "a"), (2, "short one", "a"), (3, "word " * 200_000 + "END", "b"), (4, "x" * 500_000, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = S.pack(df, room=1_000, per_shard=100).collect()
    check(got, docs, 1_000)
    assert sum(r.n_tokens for r in got if r.doc_id == 1) == 200_001

import random
import zlib

from tracelode.llm import sharding as S


def loads(rows, n=24):
    out = [0] * n
    for r in rows:
        out[r.shard] += r.size
    return out


def test_two_parts_by_hand():
    # 8 7 6 5 4: 8-7=1, 6-5=1, 4-1=3, 3-1=2, so the parts are 16 and 14.
    found = S.difference([[w, 0] for w in (8, 7, 6, 5, 4)])
    sides = [f[0] for f in found]
    assert sorted(sum(w for w, s in zip((8, 7, 6, 5, 4), sides) if s == k) for k in (0, 1)) == [14, 16]


def plain_difference(weights, parts):
    """The method on lists that are sorted anew at every step; sums and what is in them."""
    nodes = [(k, sorted([(w, [k])] + [(0, []) for _ in range(parts - 1)], key=lambda x: -x[0])) for k, w in enumerate(weights)]
    made = len(nodes)
    while len(nodes) > 1:
        nodes.sort(key=lambda n: (n[1][-1][0] - n[1][0][0], n[0]))
        (_, a), (_, b), *nodes = nodes
        joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        nodes.append((made, sorted(joined, key=lambda x: -x[0])))
        made += 1
    return nodes[0][1]


def test_shards_equal_plain_differencing(spark):
    """One level: each shard's bytes are those of the method on the groups of equal texts, heaviest first."""
    rng = random.Random(12)
    rows = [(i, f"{i} " + "x" * rng.randint(0, 900)) for i in range(300)] + [(1000 + i, f"copy {i % 5}") for i in range(40)] + [(2000, None), (2001, "long " * 60_000)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5, per_bucket=4096).collect()
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    want = sorted(n for n, _ in plain_difference(sorted(groups.values(), reverse=True), 5))
    assert sorted(loads(got, 5)) == want


def test_parts_stay_apart():
    rng = random.Random(3)
    members = [[rng.randrange(100) for _ in range(5)] for _ in range(40)]
    for f in S.difference(members):
        assert sorted(f) == list(range(5))


def test_tighter_than_dealing_in_turn():
    rng = random.Random(4)
    weights = [int(rng.lognormvariate(8, 1)) for _ in range(400)]
    found = S.difference([[w] + [0] * 7 for w in weights])
    sums = [0] * 8
    for w, f in zip(weights, found):
        sums[f[0]] += w
    assert max(sums) - min(sums) < 0.002 * sum(weights) / 8


def test_rows_groups_slots_and_levels(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abé") for _ in range(rng.randint(0, 200)))) for i in range(700)]
    rows += [(1000 + i, rows[i % 9][1]) for i in range(60)] + [(None, None), (None, ""), (7, None), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, digest int")
    got = S.shard(docs, shards=4, per_bucket=3).collect()  # so small that there are two levels
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    of = {}
    for r in got:
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    assert max(loads(got, 4)) - min(loads(got, 4)) < 0.05 * sum(loads(got, 4)) / 4


def test_empty_table(spark):
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_table_is_balanced(spark):
    got = S.op8_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and {r.law for r in got} == {"bytes"}
    assert max(loads(got)) - min(loads(got)) < 0.01 * sum(loads(got)) / 24

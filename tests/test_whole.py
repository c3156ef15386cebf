"""Queries take all rows of their tables: against plain versions on tables that reach beyond the smallest ones."""

import pandas as pd

from tracelode.plans import catalog


def test_counter_restarts_has_every_user(spark):
    d = "/root/testdata/sf0.01"
    events = pd.read_parquet(f"{d}/events.parquet").sort_values("event_id")
    want, last, seen = {}, {}, set()
    for r in events.itertuples():
        if r.event_id % 5 == 0:
            continue
        step, at = r.event_id % 50, (r.user_id, r.ts.floor("s"), r.event_id % 50)
        if at in seen:
            continue
        seen.add(at)
        was = last.get(r.user_id)
        more = step if was is None or step < was else step - was
        last[r.user_id] = step
        want[str(r.user_id)] = want.get(str(r.user_id), 0) + more
    got = {r.path: (r.input, r.output) for r in catalog.QUERIES["counter_restarts"](spark, d).collect()}
    assert max(map(int, got)) >= 40
    assert got == {u: (n, 2 * n) for u, n in want.items() if n}


def test_counter_fold_tells_the_usage_of_every_event_once(spark):
    d = "/root/testdata/sf0.01"
    events = pd.read_parquet(f"{d}/events.parquet")
    want = ((events.event_id + 1) * 1_000).groupby(events.user_id.astype(str)).sum().to_dict()
    got = {}
    for r in catalog.QUERIES["counter_fold"](spark, d).collect():
        got[r.path] = got.get(r.path, 0) + r.input
    assert got == want


def test_prefix_compare_reads_conversations_to_the_end(spark, tmp_path):
    turn = lambda n: "user" if n % 2 == 0 else "assistant"
    rows = [(c, n, turn(n) if (c, n) != (1, 12) else "system", "t") for c, size in ((0, 20), (1, 20), (2, 15), (3, 18)) for n in range(size)]
    spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.pair: (r.common, r.state, r.ahead) for r in catalog.QUERIES["prefix_compare"](spark, str(tmp_path)).collect()}
    assert len(got) == 2
    assert sorted(v[1] for v in got.values()) == ["branch_ahead", "diverged"]
    assert min(v[0] for v in got.values()) > 8
    assert sorted(v[2] for v in got.values()) == [0, 3]

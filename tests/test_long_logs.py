"""Logs and groups longer than those of the small tables."""

import glob
import random
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelode.operators import search, timeline
from tracelode.plans import catalog, formats
from tracelode.sources import jsonl
from tracelode.streaming import live


def test_nearest_mirror_reads_a_group_once_a_side(spark, capsys):
    rng = random.Random(3)
    rows = [(k % 2, rng.randrange(300), rng.choice("abx"), rng.randrange(2)) for k in range(400)]
    t = spark.createDataFrame(rows, "session long, idx long, role string, text long")
    found = timeline.nearest_mirror(t, "role", {"a": "b", "b": "a"})

    def nearest(session, idx, role, text):
        others = [i for s, i, r, x in rows if (s, r, x) == (session, {"a": "b", "b": "a"}.get(role), text)]
        return min(others, key=lambda i: (abs(i - idx), i), default=None)

    assert sorted((r.session, r.idx, r.role, r.text, r.mirror) for r in found.collect()) == sorted((*r, nearest(*r)) for r in rows)
    # A frame to the end is run through anew for every row.
    plans = [found, timeline.inclusion(t, F.col("role") == "a", F.col("idx") > 3), search.next_hits(t, F.col("role") == "a")]
    for df in plans:
        df.explain()
        assert not re.search(r"Frame, (?!unboundedpreceding)[^ ]+ unboundedfollowing", capsys.readouterr().out)


def test_revisions_of_keys_that_batches_cut(spark):
    rows = [("k", at, n) for at in range(90) for n in (2, 0, 1)][::-1]
    found = []

    class State:
        exists = False

        def update(self, value):
            self.value = value

    frame = pd.DataFrame(rows, columns=["key", "at", "tokens"])
    for out in live._newest(("k",), iter([frame[:100], frame[100:101], frame[101:]]), State()):
        found += out.itertuples(index=False, name=None)
    assert sorted(found) == sorted(("k", at, n, "late" if n else "kept") for at in range(90) for n in range(3))


@pytest.fixture(scope="module")
def long_turns(tmp_path_factory):
    """The given tables, conversations of 130 turns and of few among them."""
    d = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.execute(f"""copy (select cast(if(n < 260, n % 2, 2 + n % 15) as bigint) as conv_id, row_number() over (partition by if(n < 260, n % 2, 2 + n % 15) order by n) - 1 as turn, role, text
      from (select *, row_number() over (order by conv_id, turn) - 1 as n from '/root/testdata/sf0.001/conversations.parquet' union all
        select *, 100 + row_number() over (order by conv_id, turn) - 1 as n from '/root/testdata/sf0.01/conversations.parquet' where conv_id < 60)) to '{d}/conversations.parquet' (format parquet)""")
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    assert con.execute("select max(turn) from conversations").fetchone()[0] > 100
    return str(d), con


@pytest.mark.parametrize("key", ["grok_log", "claude_summary", "qwen_problems", "dsh_log", "nearest_hits"])
def test_long_conversations_equal_their_sql(spark, long_turns, key):
    d, con = long_turns
    df = catalog.QUERIES[key](spark, d)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in sorted(df.columns))} from ({catalog.ORACLES[key]})").fetchall()
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) == sorted(want, key=repr)


def test_turns_with_gaps_and_repeats_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    # Sessions that begin late, leave turns out, have one twice, or have a single one, and ids that are negative or null.
    con.execute(f"""copy (select cast(if(c = 50, null, c - 20) as bigint) as conv_id, cast(if(c % 11 = 10, null, t + c % 4) as bigint) as turn, 'user' as role, 'x' as text
      from range(51) s(c), range(6) u(t), range(2) v(twice) where (c + t) % 5 <> 2 and (twice = 0 or t = 3) and (c % 9 > 0 or t = 0)) to '{tmp_path}/conversations.parquet' (format parquet)""")
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    df = catalog.QUERIES["qwen_problems"](spark, str(tmp_path)).select("session", "problem")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select session, problem from ({catalog.ORACLES['qwen_problems']})").fetchall())


def test_packed_logs_read_like_files_and_are_few_files(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 200).alias("session"), F.col("id").alias("line"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("l\tü "), "id")).alias("value"))
    jsonl.pack(rows.select(F.concat(F.lit("/x/session="), "session", F.lit("/log.txt")).alias("path"), "line", "value"), f"file://{tmp_path}/packed")
    path = formats._files(rows.withColumn("value", F.coalesce("value", F.lit(" "))), "session")
    name = F.regexp_extract("path", "session=([0-9]+)", 1).alias("log")
    read = [sorted(x.select(name, "line_no", "value").collect()) for x in (jsonl.packed_lines(spark, f"file://{tmp_path}/packed"), jsonl.lines(spark, path, "*.txt"))]
    assert read[0] == read[1] and len(read[0]) == rows.where("value is not null").count()
    # A file costs the same whatever its size: logs of a query lie in few, not in one each.
    kept = formats._logs(rows, "session").removeprefix("file://")
    assert len(list(Path(kept).rglob("part-*"))) < 20


def test_followed_logs_hold_many_sessions(spark, monkeypatch):
    asked = []
    follow = live.follow
    monkeypatch.setattr(live, "follow", lambda spark, path: asked.append(path) or follow(spark, path))
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert formats.stream_appended(spark, "/root/testdata/sf0.001").count() == rows.count()
    assert 0 < len(glob.glob(asked[0].removeprefix("file://"))) <= 4 < rows.select("conv_id").distinct().count()

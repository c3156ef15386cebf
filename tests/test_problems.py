"""Rules that a log or branch has to keep, on small and odd logs."""

import json

from pyspark.sql import functions as F

from tracelode.operators import search, sessions, timeline
from tracelode.sources import agents as A

LINES = "path string, line_no long, value string"


def read(spark, rows):
    return spark.createDataFrame(rows, LINES).withColumn("json", F.try_parse_json("value"))


def test_qwen_ways(spark):
    row = lambda i, up=None, **more: json.dumps({"uuid": i, "parentUuid": up, "type": "user", **more})
    rows = [
        ("fine", 0, row("x", "gone")), ("fine", 1, row("a")), ("fine", 2, row("b", "a")), ("fine", 3, "{"),
        ("lost", 0, row("a", "gone")), ("lost", 1, row("b", "a")), ("lost", 2, row("s", "b", type="system", subtype="session_artifact_event")),
        ("ring", 0, row("a", "c")), ("ring", 1, row("b", "a")), ("ring", 2, row("c", "b")), ("self", 0, row("a", "a")), ("none", 0, "{}"),
    ]
    got = {tuple(r) for r in A.qwen_problems(read(spark, rows)).collect()}
    assert got == {("lost", "missing parent"), ("ring", "cycle"), ("self", "cycle")}
    assert A.qwen_problems(read(spark, [])).collect() == []


def test_copilot_lines(spark):
    row = lambda i, kind="user.message", **more: json.dumps({"id": i, "type": kind, "data": {"version": 1}, "timestamp": "2026-01-01T00:00:00Z", **more})
    rows = [("a", k, v) for k, v in enumerate([row("s", "session.start"), row("1", parentId="gone"), row("2", parentId="2"), row("1"), row("3", data=[]), row("4", timestamp=None), row("5", "session.start"), "{", row(None), row("6", "")])]
    got = {r.line_no: r.problem for r in A.copilot_problems(read(spark, rows + [("b", 3, row("1"))])).where("path = 'a'").collect()}
    assert got == {2: "own parent", 3: "repeated id", 4: "bad event", 5: "bad event", 6: "second start", 7: "not JSON", 8: "empty id", 9: "bad event"}
    assert [r.problem for r in A.copilot_problems(read(spark, [("b", 3, row("1"))])).collect()] == ["bad start"]
    assert A.copilot_problems(read(spark, [])).collect() == []


def test_branches(spark):
    head, said = ("session_meta", None, None), ("event_msg", "user_message", None)
    logs = {
        "fine": [head, said, ("response_item", "message", "assistant")], "tool": [head, said, ("response_item", "function_call", None)], "other": [head, said, ("response_item", "message", None)],
        "headless": [said, said, said], "short": [head, said], "empty": [],
    }
    rows = [(s, k, False, *x) for s, log in logs.items() for k, x in enumerate(log)]
    rows += [("broken", 0, True, None, None, None), ("broken", 2, False, *said), ("after", 0, False, *head), ("after", 2, False, *said), ("after", 3, True, None, None, None)]
    df = spark.createDataFrame(rows, "session string, idx long, bad boolean, outer string, kind string, role string")
    cuts = spark.createDataFrame([(s, 2) for s in [*logs, "broken", "after"]], "session string, cut long")
    assert {tuple(r) for r in timeline.prefix_problems(df, cuts).collect()} == {
        ("fine", None), ("tool", "no message"), ("other", "no message"), ("headless", "no head"), ("short", "no such line"), ("empty", "no such line"), ("broken", "bad line"), ("after", None),
    }


def test_extent_and_families(spark):
    rows = spark.createDataFrame([("a", "xx hit"), ("b", "HIT"), ("b", "hit"), ("c", None), (None, "no")], "session string, text string")
    assert tuple(search.search_extent(rows, "hit", 1).first()) == (2, 1, True)
    assert tuple(search.search_extent(rows, "hit", 2).first()) == (2, 2, False)
    assert tuple(search.search_extent(rows.where("false"), "hit").first()) == (0, 0, False)
    s = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q"), (None, "p")], "id string, provider string")
    index = spark.createDataFrame([("1", "f"), ("2", "lost"), ("3", "lost"), ("4", "lost"), ("1", None)], "id string, family string")
    assert [tuple(r) for r in sessions.dangling_families(s, index, spark.createDataFrame([("f",)], "family string"), "p").collect()] == [("2", "lost")]

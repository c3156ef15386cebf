"""Log formats, databases, sinks and streams on inline files."""

import json
import sqlite3
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from tracelode.operators import stats
from tracelode.plans import tables
from tracelode.sources import agents as A
from tracelode.sources import databases as D
from tracelode.sources import jsonl as J
from tracelode.sources import sinks as K
from tracelode.streaming import live as L


def write(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(folder)


def read(spark, where, policy="tolerant"):
    return J.parsed(J.lines(spark, where), policy)


def test_lines_policies_and_validation(spark, tmp_path):
    where = write(tmp_path / "a", "x.jsonl", {"a": 1}, "", "{bad", {"a": 2})
    write(tmp_path / "a", "y.jsonl", "no", "nor this")
    rows = J.lines(spark, where)
    assert sorted(r.line_no for r in rows.where("path like '%x.jsonl'").collect()) == [0, 2, 3]
    assert J.parsed(rows).count() == 2
    assert J.parsed(rows, "tolerant_unless_all_bad").where("json is null").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        J.parsed(rows, "strict").select("json").collect()
    assert {(r.n_lines, r.n_bad, r.ok) for r in J.validation(rows).collect()} == {(3, 1, False), (2, 2, False)}


def test_claude_summary(spark, tmp_path):
    where = write(
        tmp_path / "c", "s.jsonl",
        {"type": "user", "sessionId": "s1", "cwd": "/w/demo", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "Caveat: x"}},
        {"type": "user", "timestamp": "2026-01-01T00:00:10Z", "message": {"role": "user", "content": [{"type": "text", "text": "do it"}]}},
        {"type": "assistant", "timestamp": 1767225640000, "message": {"role": "assistant", "model": "m", "content": "done", "usage": {"input_tokens": 3, "output_tokens": 4}}},
    )
    (r,) = A.claude_summaries(read(spark, where)).collect()
    assert (r.id, r.cwd, r.model, r.tokens_used, r.first_user_message, r.title) == ("s1", "/w/demo", "m", 7, "do it", "do it")
    assert r.updated_at - r.created_at == 40


def test_workbuddy_keeps_the_last_query(spark, tmp_path):
    where = write(
        tmp_path / "w", "s.jsonl",
        {"type": "message", "role": "user", "timestamp": 1700000000123, "content": [{"type": "input_text", "text": "hidden <user_query>a</user_query> <user_query> a wish </user_query>"}]},
        {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "answer"}]},
        {"type": "function_call_result", "content": "hidden"},
    )
    got = [(r.role, r.text) for r in A.workbuddy_events(read(spark, where)).orderBy("line_no").collect()]
    assert got == [("user", "a wish"), ("assistant", "answer"), ("meta", "")]


def test_grok_joins_chunks_and_rewinds(spark, tmp_path):
    def up(kind, text=None, prompt=None, method="session/update", **more):
        u = {"sessionUpdate": kind, **more}
        u |= {"content": {"type": "text", "text": text}} if text else {}
        u |= {"_meta": {"promptIndex": prompt}} if prompt is not None else {}
        return {"timestamp": 1, "method": method, "params": {"update": u}}

    where = write(
        tmp_path / "g", "u.jsonl",
        up("user_message_chunk", "hello ", 0), up("user_message_chunk", "world", 0), up("agent_message_chunk", "re"), up("agent_message_chunk", "ply"),
        up("user_message_chunk", "taken back", 1), up("agent_message_chunk", "lost"), up("rewind_marker", method="_x.ai/session/update", target_prompt_index=1),
        up("user_message_chunk", "again", 1), up("tool_call", toolCallId="t", title="Read"), up("tool_call_update", toolCallId="t", title="Read file"),
    )
    got = [(r.role, r.text) for r in A.grok_events(read(spark, where)).orderBy("line_no").collect()]
    assert got == [("user", "hello world"), ("assistant", "reply"), ("user", "again"), ("tool_call", "Read file")]


def test_qwen_follows_the_last_row_and_merges_fragments(spark, tmp_path):
    def row(uuid, parent, kind, *parts, **more):
        return {"uuid": uuid, "parentUuid": parent, "sessionId": "s", "type": kind, "message": {"parts": [{"text": p} for p in parts]}, **more}

    where = write(tmp_path / "q", "s.jsonl", row("u1", None, "user", "asked", "<qwen:user-prompt-submit-context>x"), row("dead", "u1", "assistant", "no"), row("a1", "u1", "assistant", "active "), row("a1", "u1", "assistant", "tail"), row("art", "dead", "system", subtype="session_artifact_event"))
    got = [(r.role, r.text) for r in A.qwen_events(read(spark, where)).orderBy("place").collect()]
    assert got == [("user", "asked"), ("assistant", "active tail")]


def test_pi_copilot_antigravity_and_history(spark, tmp_path):
    where = write(tmp_path / "p", "s.jsonl", {"type": "session", "id": "s"}, *[{"type": "message", "id": i, "parentId": p, "message": {"role": "user", "content": i}} for i, p in [("a", None), ("b", "a"), ("c", "a")]])
    assert [r.text for r in A.pi_events(read(spark, where)).orderBy("line_no").collect()] == ["a", "c"]
    where = write(tmp_path / "o", "s.jsonl", {"type": "user.message", "id": "1", "data": {"content": "hi"}}, {"type": "user.message", "id": "1", "data": {"content": "twice"}}, {"type": "assistant.message", "id": "2", "data": {"content": "yo", "parentAgentTaskId": "x"}})
    assert [(r.role, r.text) for r in A.copilot_events(read(spark, where)).orderBy("line_no").collect()] == [("user", "hi"), ("meta", "yo")]
    where = write(tmp_path / "g", "s.jsonl", {"step_index": 0, "type": "USER_INPUT", "created_at": "2025-03-04T05:06:07Z", "content": "<USER_REQUEST>\nSum it up.\n</USER_REQUEST>"}, {"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "content": "ok", "truncated_fields": ["content"]})
    assert [(r.role, r.text, r.cut) for r in A.antigravity_events(read(spark, where)).orderBy("idx").collect()] == [("user", "Sum it up.", False), ("assistant", "ok", True)]
    where = write(tmp_path / "h", "s.jsonl", {"sessionId": " ", "session_id": "b"}, {"id": "c"}, {"x": 1})
    assert [r.session for r in A.history_ids(read(spark, where)).orderBy("line_no").collect()] == ["b", "c", None]


def test_dsh_reads_the_highest_version_compressed(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    for name, version, word in (("v3.zstd", 3, "old"), ("v4.zstd", 4, "new")):
        rows = [{"type": "session", "version": version}, {"type": "user/message", "seq": 0, "time": 1000, "data": {"content": [{"type": "text", "text": word}]}}, {"type": "assistant/message", "seq": 2, "time": 2000, "data": {"message": {"content": [{"type": "text", "text": "x"}]}}}]
        (folder / name).write_bytes(zstandard.compress("\n".join(map(json.dumps, rows)).encode()))
    got = A.dsh_events(J.parsed(A.zstd_lines(spark, str(folder)))).orderBy("seq").collect()
    assert [(r.role, r.text, r.whole) for r in got] == [("user", "new", False), ("assistant", "x", False)]


def test_codex_briefs_and_supplement(spark, tmp_path):
    where = write(
        tmp_path / "x", "r.jsonl",
        {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "i", "cwd": "/c"}},
        {"timestamp": "2026-01-01T00:00:02Z", "type": "event_msg", "payload": {"type": "user_message", "message": " hi "}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 9}}}},
    )
    briefs = A.codex_briefs(read(spark, where))
    (r,) = briefs.collect()
    assert (r.id, r.cwd, r.model_provider, r.updated_at - r.created_at, r.tokens_used, r.first_user_message) == ("i", "/c", "openai", 2, 9, "hi")
    known = spark.createDataFrame([("/other/z.jsonl", "i", False)], "path string, id string, archived boolean")
    assert A.supplement(known, briefs.select("path", "id")).count() == 1
    assert A.supplement(known.withColumn("id", F.lit("j")), briefs.select("path", "id")).count() == 2


def test_blobs_reach_their_children(spark):
    a, b, c = (bytes([k]) * 32 for k in (1, 2, 3))
    child = lambda x: b"\x0a\x20" + x
    blobs = spark.createDataFrame([(a.hex(), bytearray(b"\x10\x05" + child(b))), (b.hex(), bytearray(b"text")), (c.hex(), bytearray(b""))], "id string, data binary")
    got = A.reachable_blobs(blobs, spark.createDataFrame([(a.hex(),)], "id string")).collect()
    assert {(r.id, r.depth) for r in got} == {(a.hex(), 0), (b.hex(), 1)}


def test_sqlite_tables(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "h.db")
    db.executescript("""create table messages(id integer primary key, session_id text, role text, content text, timestamp real);
      insert into messages values (1, 's', 'user', 'q', 1001.5), (2, 's', 'assistant', 'a', 1002), (9, 's', 'tool', null, 1003);
      create table session(id text, directory text, title text, time_created integer, time_updated integer);
      create table message(id text, session_id text, time_created integer, data text, sequence integer);
      create table part(id text, message_id text, session_id text, time_created integer, data text, sequence integer);
      insert into message values ('a', 's', 1, '{"role":"assistant"}', 1), ('u', 's', 2, '{"role":"user"}', 0);
      insert into part values ('p1', 'a', 's', 1, '{"type":"text","text":"answer"}', 0), ('p2', 'u', 's', 1, '{"type":"text","text":"question"}', null);""")
    db.commit()
    db.close()
    rows = D.sqlite(spark, str(tmp_path), "messages", "id long, role string, nothing string, _path string", rows=2).collect()
    assert sorted((r.id, r.role, r.nothing) for r in rows) == [(1, "user", None), (2, "assistant", None), (9, "tool", None)]
    assert [(r.at, r.text) for r in D.hermes_events(spark, str(tmp_path)).orderBy("idx").collect()] == [(1001, "q"), (1002, "a"), (1003, "")]
    assert [(r.role, r.text) for r in D.zcode_events(spark, str(tmp_path)).orderBy("place").collect()] == [("user", "question"), ("assistant", "answer")]
    assert D.sqlite(spark, str(tmp_path), "absent", "id long").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "daily", "=1+1", 5), (2, "daily", None, None)], "place int, record_type string, note string, tokens int")
    lines = [r.line for r in K.csv_lines([rows], ("record_type", "tokens", "note")).orderBy("place").collect()]
    assert lines == ['﻿"record_type","tokens","note"\r', '"daily","5","\'=1+1"\r', '"daily",,\r']
    K.write_csv([rows], str(tmp_path / "csv"))
    events = spark.createDataFrame([("s", 2, "assistant", "a"), ("s", 1, "user", "q"), ("s", 3, "tool_call", "t")], "session string, idx int, role string, text string")
    assert K.markdown(events).first().markdown == "## User\n\nq\n\n## Assistant\n\na\n"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, n int")
    assert sorted(map(tuple, K.upserted(old.withColumn("n", F.lit(0)), new, "id", order="n").select("id", "v").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    hist = spark.createDataFrame([("x",)], "value string")
    assert K.appended(hist, spark.createDataFrame([("x",), ("y",), ("y",), (" ",)], "value string")).count() == 2


def test_appended_lines_are_followed(spark, tmp_path):
    log = tmp_path / "in" / "a.jsonl"
    log.parent.mkdir()
    log.write_bytes(b'{"n":1}\n{"n":2}\n{"part')

    def run():
        q = L.follow(spark, str(log.parent), str(tmp_path / "digests")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ['{"n":1}', '{"n":2}']
    with log.open("ab") as f:
        f.write(b'":3}\n')
    assert run() == ['{"n":1}', '{"n":2}', '{"part":3}']


def test_a_replaced_log_is_read_anew(spark, tmp_path):
    log = tmp_path / "in" / "a.jsonl"
    log.parent.mkdir()
    reader = L._Follow({"path": str(log.parent), "digests": str(tmp_path / "digests")})
    log.write_bytes(b"one\ntwo\n")
    first = reader.latestOffset()
    assert reader.partitions(first, reader.latestOffset())[0].path == ""
    with log.open("ab") as f:
        f.write(b"three\n")
    grown = reader.latestOffset()
    assert [(s.first, s.last) for s in reader.partitions(first, grown)] == [(8, 14)]
    log.write_bytes(b"other\nlines\nlonger than before\n")
    (span,) = reader.partitions(grown, reader.latestOffset())
    assert [v for _, _, v in reader.read(span)] == ["other", "lines", "longer than before"]
    log.write_bytes(b"x\n")
    assert [(s.first, s.last) for s in reader.partitions(grown, reader.latestOffset())] == [(0, 2)]


def test_a_byte_changed_in_the_middle_of_a_long_log_is_noticed(spark, tmp_path):
    log = tmp_path / "in" / "a.jsonl"
    log.parent.mkdir()
    lines = [f"line {i:06d} {'x' * 40}" for i in range(25_000)]
    log.write_text("\n".join(lines) + "\n")
    assert log.stat().st_size > 1_200_000

    def run():
        q = L.follow(spark, str(log.parent), str(tmp_path / "digests")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 25_000
    with log.open("a") as f:
        f.write("one more\n")
    assert run() == 25_001  # continued
    with log.open("r+b") as f:
        f.seek(600_000)
        f.write(b"!")
    with log.open("a") as f:
        f.write("and another\n")
    assert run() == 25_001 + 25_002  # read anew
    with log.open("r+b") as f:
        f.seek(600_001)
        f.write(b"!")
    assert run() == 25_001 + 25_002 * 2  # as long as before, but another text
    log.touch()
    assert run() == 25_001 + 25_002 * 2


def test_a_commit_is_checked_against_what_tasks_recorded(tmp_path):
    log = tmp_path / "in" / "a.jsonl"
    log.parent.mkdir()
    reader = L._Follow({"path": str(log.parent), "digests": str(tmp_path / "digests")})
    offsets = [{}]
    for text in (b"one\n", b"two\n", b"three\n"):
        with log.open("ab") as f:
            f.write(text)
        offsets.append(reader.latestOffset())
        (span,) = reader.partitions(offsets[-2], offsets[-1])
        assert len(list(reader.read(span))) == 1
        reader.commit(offsets[-1])
    path = str(log)
    assert reader.records.get(path, 4) is None and reader.records.get(path, 14)["resumed"]
    with log.open("ab") as f:
        f.write(b"four\n")
    last = reader.latestOffset()
    list(reader.read(reader.partitions(offsets[-1], last)[0]))
    reader.records.put(path, 14, digest="of other bytes", resumed=True, verified="")
    with pytest.raises(ValueError, match="content changed"):
        reader.commit(last)


def test_a_run_is_given_out_once_its_key_is_idle(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "a", "x"), ("k", 2, "a", "y"), ("k", 3, "b", "z"), ("m", 1, "a", "w")], "key string, line_no long, kind string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = L.joined_chunks(source, idle_ms=1_000).writeStream.format("memory").queryName("idle_runs").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            found = sorted(map(tuple, spark.table("idle_runs").collect()))
            if len(found) == 3:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert found == [("k", 1, "a", "xy"), ("k", 3, "b", "z"), ("m", 1, "a", "w")]


def test_depth_one_logs_and_their_events(spark, tmp_path):
    turn = lambda role, content, **more: {"type": role, "sessionId": "q1", "message": {"role": role, "content": content}, **more}
    where = write(tmp_path / "proj", "s.jsonl", turn("user", "hello"), turn("assistant", [{"type": "output_text", "text": "hi"}, {"type": "secret", "text": "no"}]), turn("assistant", "aside", isSidechain=True))
    write(tmp_path / "proj" / "deeper", "t.jsonl", turn("user", "below"))
    rows = J.parsed(J.lines(spark, where, deep=False))
    assert [(r.role, r.text) for r in A.qoder_events(rows).orderBy("line_no").collect()] == [("user", "hello"), ("assistant", "hi"), ("meta", "aside")]
    (r,) = A.qoder_summaries(rows).collect()
    assert (r.provider, r.source, r.id, r.first_user_message) == ("qoder", "cli", "q1", "hello")


def test_notes_and_statistics_of_one_set(spark, tmp_path):
    (tmp_path / "m" / "p1" / "memory").mkdir(parents=True)
    (tmp_path / "m" / "p1" / "memory" / "MEMORY.md").write_text("abc")
    (tmp_path / "m" / "p1" / "memory" / "x.md").write_text("de")
    (r,) = A.memory_projects(spark, str(tmp_path / "m")).collect()
    assert (r.project, r.files, r.bytes, r.has_index) == ("p1", 2, 5, True)
    s = tables.sessions(spark, "/root/testdata/sf0.001")
    parts = stats.snapshot(s)
    assert parts["kpi"].collect() == stats.kpi(s).collect()
    assert sorted(parts["heatmap"].collect()) == sorted(stats.heatmap(s).collect())


def test_cursor_decisions():
    c = L.Cursor("i", 10, 5, 10, "h")
    cases = [(("i", 10, 5, "h"), "unchanged"), (("i", 12, 6, "h"), "resume"), (("j", 12, 6, "h"), "file replaced"), (("i", 9, 6, "h"), "truncated"), (("i", 12, 6, None), "hash unverified"), (("i", 12, 6, "x"), "content changed"), (("i", 10, 6, "h"), "content changed"), ((None, 10, 5, "h"), "identity unavailable")]
    for args, want in cases:
        what, reason = L.decide(c, *args)
        assert (reason or what) == want
    assert L.decide(c, "i", 10, 5, "h", "2")[1] == "parser version changed"
    with pytest.raises(ValueError):
        L.checked_append(c, L.Cursor("i", 12, 6, 8, "k"), "h")


def test_stream_of_revisions_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, 3), ("k", 5, 8), ("k", 5, 8), ("k", 2, 4)], "key string, at long, tokens long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = L.revisions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("revised").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.at, r.what) for r in spark.table("revised").collect()) == [(1, "kept"), (2, "kept"), (5, "kept")]
    t = spark.createDataFrame([("2024-01-07 23:00:00", 1), ("2024-01-08 01:00:00", 2), (None, 4)], "ts string, tokens int").withColumn("ts", F.to_timestamp("ts"))
    dated, undated = L.split_undated(t, F.col("ts"))
    assert [str(r.start) for r in L.by_week(dated).orderBy("start").collect()] == ["2024-01-01 00:00:00", "2024-01-08 00:00:00"]
    assert L.by_day(dated).count() == 2 and undated.count() == 1

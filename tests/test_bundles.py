"""Bundles that are whole or absent, and logs read from one end."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelode.sources import bundles as B
from tracelode.sources import ends as E


def some(spark):
    sessions = spark.createDataFrame([("a", "p", 5, False), ("b", "q", 9, True), ("c", "q", None, None), ("none", "p", 5, False), (None, "p", 5, False), ("a", "old", 4, False)], "session string, provider string, updated_at long, archived boolean")
    lines = spark.createDataFrame([("a", k, f"line {k}") for k in range(7)] + [("b", 1, "é"), ("b", 0, None), ("c", None, "c"), ("x", 0, "x"), (None, 0, "n")], "session string, line_no long, line string")
    return sessions, lines


def test_bundles_are_verified(spark, tmp_path):
    sessions, lines = some(spark)
    where = str(tmp_path / "one")
    B.export_bundle(sessions, lines, where, 100, chunk=5)
    B.export_bundle(sessions, lines, "file://" + str(tmp_path / "two"), 101, start=5, end=9)
    B.export_bundle(sessions, lines, str(tmp_path / "three"), 102, active_only=True)
    files = {(r.session, r.chunk): r for r in B.verified(spark, where).collect()}
    assert sorted(files) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    assert all(r.verified and r.found_bytes == r.bytes and r.exported_at == 100 for r in files.values())
    a = files["a", 0]
    text = "".join(f"line {k}\n" for k in range(5)).encode()
    assert (a.provider, a.updated_at, a.n_lines, a.bytes, a.sha256) == ("p", 5, 5, len(text), hashlib.sha256(text).hexdigest())
    assert (Path(where) / a.file).read_bytes() == text and files["b", 0].bytes == len("\né\n".encode())
    whole = B.verified(spark, str(tmp_path))
    assert {(r.exported_at, r.session) for r in whole.collect()} == {(100, "a"), (100, "b"), (100, "c"), (101, "a"), (102, "a"), (102, "c")}
    assert B.verified(spark, str(tmp_path), "q").select("session").distinct().count() == 2
    assert B.bundles(spark, str(tmp_path)).select("bundle").distinct().count() == 3

    (Path(where) / a.file).write_bytes(text[:-2] + b"X\n")
    (Path(where) / files["b", 0].file).unlink()
    checked = {(r.session, r.chunk): (r.found_bytes, r.verified) for r in B.verified(spark, where).collect()}
    assert checked == {("a", 0): (len(text), False), ("a", 1): (14, True), ("b", 0): (None, False), ("c", 0): (2, True)}


def test_a_bundle_is_refused_or_empty(spark, tmp_path):
    sessions, lines = some(spark)
    where = str(tmp_path / "b")
    with pytest.raises(ValueError, match="begins"):
        B.export_bundle(sessions, lines, where, 1, start=3, end=3)
    B.export_bundle(sessions, lines, where, 1, start=1_000)
    assert (tmp_path / "b" / B.MANIFEST).read_text() == ""
    with pytest.raises(FileExistsError):
        B.export_bundle(sessions, lines, where, 1)


def test_a_failed_job_leaves_no_bundle(spark, tmp_path):
    sessions, lines = some(spark)
    where = tmp_path / "b"
    wrong = lines.withColumn("line", F.when(F.col("session") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("line")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        B.export_bundle(sessions, wrong, str(where), 1)
    assert not (where / B.MANIFEST).exists()
    # what an attempt left behind doesn't count once another job commits
    stray = where / "parts" / "lost-attempt"
    stray.mkdir(parents=True)
    (stray / "files.jsonl").write_text(json.dumps({"session": "stray", "file": "parts/lost-attempt/0.jsonl", "version": 2}) + "\n")
    B.export_bundle(sessions, lines, str(where), 2)
    assert {r.session for r in B.verified(spark, str(where)).collect()} == {"a", "b", "c"}


def counter(n, **more):
    return json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": n}}}, **more})


def test_ends_are_read_in_blocks(spark, tmp_path):
    filler = [json.dumps({"type": "x", "text": "y" * 90}) for _ in range(5_000)]
    logs = {
        "long": [json.dumps({"type": "session_meta", "payload": {"id": " i ", "source": "cli"}}), *filler, counter(3), *filler, counter(8), "{broken", counter(-1), counter(True), counter(1.5)],
        "wide": [counter(7), json.dumps({"type": "token_count", "text": "z" * 5_000})],
        "escaped": [counter(4).replace("token_count", "token_\\u0063ount"), "", json.dumps({"type": "session_meta", "payload": {"id": " "}}), json.dumps({"type": "session_meta", "payload": {"id": "e", "model_provider": 3}})],
        "other": [json.dumps({"type": "event_msg", "payload": {"type": "token_count", "total_tokens": 6}, "total_tokens": 9}), '"token_count"', "[1]"],
        "empty": [],  # Spark lists no file of no bytes
    }
    for name, rows in logs.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + ("\n" if name == "long" else ""))
    for block in (7, 4_096, 1 << 20):
        rows = {r.path.rsplit("/", 1)[1][:-6]: r for r in E.token_totals(spark, str(tmp_path), block=block).collect()}
        assert {k: r.total for k, r in rows.items()} == {"long": 8, "wide": 7, "escaped": 4, "other": 6}
        ids = {r.path.rsplit("/", 1)[1][:-6]: r for r in E.identities(spark, str(tmp_path), block=block).collect()}
        assert {k: (r.id, r.model_provider, r.source) for k, r in ids.items()} == {"long": ("i", "openai", "cli"), "escaped": ("e", "openai", None)}
        if block == 4_096:
            assert rows["long"].bytes_read == ids["long"].bytes_read == 4_096 < (tmp_path / "long.jsonl").stat().st_size / 200

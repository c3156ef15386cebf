import hashlib
import random
import re

import duckdb
import pytest

from tracelode.llm import secrets as S
from tracelode.llm.automaton import Dfa, scanner

BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "pem": r"-----BEGIN[A-Z ]*PRIVATE KEY-----",
    "github": r"gh[opsru]_[A-Za-z0-9]+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]+",
}
KEEP = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16, "pem": lambda m: True, "github": lambda m: len(m[0]) >= 40, "slack": lambda m: len(m[0]) >= 15}


def plain(text):
    order = list(BASE)
    found = [(m.start(), order.index(k), m.end()) for k, p in BASE.items() for m in re.finditer(p, text, re.ASCII) if KEEP[k](m)]
    return [(order[k], a, b) for a, k, b in sorted(found)]


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["password", "Passwd", "secret", "token", "api_key", "APIKEY", ":", "=", " ", "  ", '"', "'", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "deadbeef", "é", "日", "\n", "xoxb-", "12345-67890-a", "ghp_", "a" * 36, "-----", "BEGIN", " RSA ", "PRIVATE KEY", "x", "_", "abcdefghijkl"]
    for _ in range(n):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


@pytest.mark.parametrize("seed", range(4))
def test_scanner_agrees_with_regexes(seed):
    find = scanner(S.RULES).spans
    for text in texts(seed, 1500):
        assert find(text) == plain(text), text


def test_automaton_is_minimal():
    assert Dfa(["(a|b)*abb"]).states == 5  # with the dead one
    assert Dfa(["ab|ab|a(b)"]).states == 4


def test_query_and_its_sql_agree(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(9, 200))] + [(None, None), (500, ""), (501, "password=abcdefghijklmnop"), (501, "password=abcdefghijklmnop"), (502, "x" * 200_000 + " 0123456789abcdef")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    got = spark.createDataFrame(S.op3_secrets(spark, str(tmp_path)).collect(), S.op3_secrets(spark, str(tmp_path)).schema).collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(S.OP3_SQL).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    for _, *counts, digest, spans in want:
        base = [s for s in spans.split(",") if s.split(":")[0] in S.BASE]
        assert len(base) == sum(counts)
        assert digest == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_redact_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefghijklmnop end", 28), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert S.redact(docs).orderBy("doc_id").collect() == [(1, "é <secret> end", 14), (2, None, None), (3, "clean", 5)]
    assert S.redact(docs.limit(0)).count() == 0


def test_spans_of_a_very_long_text(spark):
    text = "".join(f"é{i} token={'k' * 12}{i}\n日 {'ab' * 9} " for i in range(20_000))
    (r,) = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.spans == [f"{k}:{a}:{b}" for k, a, b in plain(text)]
    assert len(r.spans) == 40_000

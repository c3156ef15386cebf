import hashlib
import random
import re

import numpy as np
import pytest

from tracelode.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


KEEP = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
    "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
}


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if KEEP[k](m[0])]


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "@", ".", "..", "com", "%", "_", "-", "+", "+1", " ", "  ", "(", ")", "1", "255", "256", "00012", "4111111111111111", "1.2", "é", "\n", "555", "4111 1111-1111 1111", "٣"]
    for _ in range(n):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_follow_the_patterns(seed):
    for text in texts(seed, 4000):
        assert P.base_spans(text) == plain(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 50_000 + "a@b.c", "+1" + " " * 200_000):
        P.base_spans(text)


def best_by_trying_all(field, row):
    e = field.potentials([row])[0]
    n, best = len(P.LABELS), None
    for code in range(n ** len(row)):
        path = [code // n**t % n for t in range(len(row))]
        score = sum(e[t][k] for t, k in enumerate(path)) + sum(field.step[a][b] for a, b in zip(path, path[1:]))
        if best is None or score > best[0]:
            best = (score, path)
    return best[0]


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(3)
    field = P.Field(rng.normal(size=(3, P.SHAPES + 1, len(P.LABELS))), rng.normal(size=(len(P.LABELS),) * 2))
    rows = [rng.integers(0, P.SHAPES, n).tolist() for n in (4, 1, 3, 0, 4, 2)]
    for row, path in zip(rows, field.decode(rows, cells=8), strict=True):
        if row:
            e = field.potentials([row])[0]
            score = sum(e[t][k] for t, k in enumerate(path)) + sum(field.step[a][b] for a, b in zip(path, path[1:]))
            assert score == pytest.approx(best_by_trying_all(field, row))


def test_field_learns_its_table_and_other_lines_of_the_kind():
    field = P.trained()
    for table in (P.labelled_table(), P.labelled_table(3, 99)):
        right = total = 0
        for (words, labels), path in zip(table, field.decode([[P.shape(w) for w in words] for words, _ in table]), strict=True):
            right += sum(a == b for a, b in zip(labels, path))
            total += len(labels)
        assert right / total > 0.985


def test_field_adds_numbers_and_leaves_others():
    found = P.all_spans(["call (212) 555-0182 now", "the ssn 078-05-1120, given", "in 2024 there were 17 of 300", "mail a.b@c.org +1 (743) 555-3824 .", "words only", "version 3."])
    assert found[0] == [("local_phone", 5, 19)]
    assert found[1] == [("id_number", 8, 19)]
    assert [k for k, _, _ in found[3]] == ["email", "phone"]
    assert found[2] == found[4] == found[5] == []


def test_query_rows(spark, tmp_path):
    rows = [(1, "é a@b.cd and 1.2.3.4"), (None, None), (2, ""), (1, "é a@b.cd and 1.2.3.4"), (3, "x " * 60_000 + "4111 1111 1111 1111")]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.spans): r for r in P.op9_pii(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    r = got[1, "email:2:8,ip:13:20"]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)
    assert r.base_sha256 == hashlib.sha256(b"email:2:8,ip:13:20").hexdigest()
    assert (3, "card:120000:120019") in got
    assert P.find_personal(spark.createDataFrame([], "doc_id long, text string")).count() == 0

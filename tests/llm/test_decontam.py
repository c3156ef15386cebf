import random

import pytest

from tracelode.llm import decontam as D


def best_by_table(item, text):
    """Sellers' table: the least distance of the item to any stretch of the text, and its first end."""
    column = list(range(len(item) + 1))
    best = (column[-1], 0)
    for j, c in enumerate(text, 1):
        last, column[0] = column[0], 0
        for i, d in enumerate(item, 1):
            last, column[i] = column[i], min(last + (c != d), column[i] + 1, column[i - 1] + 1)
        best = min(best, (column[-1], j))
    return best


def edited(rng, text, n):
    for _ in range(n):
        text = text or "a"
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "q", text[at] + "z"]) + text[at + 1 :]
    return text


@pytest.mark.parametrize("seed", range(3))
def test_myers_against_the_table(seed):
    rng = random.Random(seed)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + edited(rng, item, rng.randint(0, 6)) + "".join(rng.choice("abc") for _ in range(20))
        want = best_by_table(item, text)
        for k in (0, 2, 5):
            assert D.myers(item, text, k) == (want if want[0] <= k else None)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "er", "ti", "é"]) for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(12)]
    rows = []
    for i in range(120):
        body = " ".join(word() for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            item = rng.choice(items)[1]
            body += " " + edited(rng, item, rng.randint(0, len(item) // 10)) + "\n" + word()
        rows.append((i, body.upper() if i % 7 == 0 else body))
    return items, rows


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_against_comparing_all(spark, most):
    items, rows = corpus(11)
    rows += [(None, items[0][1]), (500, None), (501, ""), (3, rows[3][1]), (502, "x " * 40_000 + items[1][1])]
    given = items + [(90, None), (91, ""), (92, "short"), (None, items[2][1])]
    docs = spark.createDataFrame([(*r, "a", 0) for r in rows], "doc_id long, text string, item_id string, distance int")
    got = D.leaks(docs, spark.createDataFrame(given, "item_id long, text string"), most=most).collect()
    want = []
    for i, text in rows:
        for name, item in items:
            item = D.plain(item)
            body = D.plain(text)
            if item and len(body) < 50_000:
                d, end = best_by_table(item, body)
                if d <= len(item) * 5 // 100:
                    want.append((i, name, d, end))
    want.append((502, 1, 0, 80_000 + len(D.plain(items[1][1]))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_items_of_every_length_by_one_rule(spark):
    """5 to 60 characters: under 20 without edits, from 20 with one, and so on; parts of words count."""
    rng = random.Random(5)
    letters = "abcdefgh "
    items = [(n, "".join(rng.choice(letters) for _ in range(n)).strip() or "abcde") for n in range(5, 61)]
    rows = [(i, rng.choice(letters) * rng.randint(0, 3) + edited(rng, D.plain(rng.choice(items)[1]), rng.choice([0, 0, 1, 1, 2, 3])).upper() + "x" * rng.randint(0, 4)) for i in range(400)]
    rows += [(1_000, "Abcdefghijklmnopqrstuvx"), (1_001, "xabcdefghij klmnopqrsty")]
    items += [(61, "abcdefghijklmnopqrstu"), (62, "abcdefghij klmnopqrst"), (63, "The  cat")]
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, text in rows:
        for name, item in items:
            item = D.plain(item)
            d, end = best_by_table(item, D.plain(text))
            if d <= len(item) * 5 // 100:
                want.append((i, name, d, end))
    assert sorted(map(tuple, got)) == sorted(want)
    assert {(1_000, 61), (1_001, 62)} <= {(w[0], w[1]) for w in want} and len(want) > 150 and {w[2] for w in want} >= {0, 1, 2}


def test_drop_leaking_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "a passage that is long enough to count here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A passage that is  long enough to count here y", "s"), (2, None, "s"), (3, "clean", "s")], "doc_id long, text string, source string")
    assert D.drop_leaking(docs, items).orderBy("doc_id").collect() == [(2, None, "s"), (3, "clean", "s")]
    assert D.leaks(docs.limit(0), items).count() == 0
    assert D.leaks(docs, items.limit(0)).count() == 0
    assert D.drop_leaking(docs, items.limit(0)).count() == 3

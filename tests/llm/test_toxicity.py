import random
import time
import zlib

import numpy as np
import pytest

from tracelode.llm import toxicity as X

RUDE = ("idiot", "moron", "loser")


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "er", "in", "sh", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=900):
    rng, rows, labels = random.Random(4), [], []
    noisy = {"idiot": ["1d10t", "i d i o t", "idiooot", "!d!ot"], "moron": ["m0r0n", "m.o.r.o.n", "mooooron"], "loser": ["l0s3r", "lo$er", "l o s e r"]}
    for i in range(n):
        words = prose(rng, rng.randint(5, 60)).split(" ")
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w = rng.choice(RUDE)
            words.insert(rng.randrange(len(words)), rng.choice(noisy[w]) if i % 3 == 0 else w)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, score string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), dict((i, t) for i, _, t in labels)


def test_held_out_accuracy_with_disguised_words(tables):
    docs, labels, truth = tables
    rows = X.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_change_nothing(tables):
    docs, labels, _ = tables
    lied = labels.withColumn("toxic", X.F.when(X.held_out(), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    assert sorted(X.toxicity(docs, labels).collect()) == sorted(X.toxicity(docs, lied).collect())


def test_decoder_is_as_good_as_trying_all_readings():
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(X.SYMBOLS), (X.SYMBOLS, X.SYMBOLS)))
    reader = X.Restorer(log_p)

    def readings(noisy, folds, last=""):
        if not noisy:
            yield 0.0, ""
            return
        c, rest = noisy[0], noisy[1:]
        stands = [(c, 0.0)] if c.isalpha() else [(x, X._STAND) for x in X.STANDS_FOR.get(c, "")]
        if not c.isalpha():
            for p, w in readings(rest, folds[1:], last):
                yield p + (X._NOISE if stands else X._SKIP), w
        for x, cost in stands:
            if folds[0] and x == last:
                for p, w in readings(rest, folds[1:], last):
                    yield p + cost + X._FOLD, w
            for p, w in readings(rest, folds[1:], x):
                yield p + cost, x + w

    def total(p, word):
        s = [0, 0, *[ord(c) - 96 for c in word], 0]
        return p + sum(log_p[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))

    for noisy in ("a1b", "l0000se", "i.d.1", "aaab", "6.6", "s$$$a", "1111"):
        best = max(readings(noisy, X._in_runs(noisy)), key=lambda r: total(*r))
        assert reader.read(noisy) == best[1], noisy


def test_long_stretches_and_texts_take_time_in_proportion():
    reader = X.Restorer(np.log(np.full((X.SYMBOLS,) * 3, 1 / X.SYMBOLS)))
    text = "1d10t" * 60_000 + " " + "m0r0n " * 60_000
    began = time.perf_counter()
    restored = reader.restore(text)
    assert time.perf_counter() - began < 20
    assert restored.count(" ") == 60_001 and len(reader.known) == 1


def test_clean_text_stays():
    reader = X.Restorer(np.zeros((X.SYMBOLS,) * 3))
    for text in ("plain words, and 17 more!!", "", "3.14 (yes) 50% a b", "Éa Über"):
        assert reader.restore(text) == text.lower()


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, "you idiot"), (None, "you idiot"), (2, ""), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    rows = X.toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(r.held_out is not None and 0 <= r.score <= 1 for r in rows)
    assert X.toxicity(docs.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in X.toxicity(docs, labels.limit(0)).collect()} == {0.0}

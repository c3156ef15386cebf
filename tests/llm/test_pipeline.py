"""run() against a plain version of every stage on a small fixture."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelode.llm import packing, secrets, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r for r in docs.collect() if r.doc_id < 70 and len(r.text or "") < 6_000]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    base = " ".join(f"word{i}" for i in range(120))
    more = [
        (9001, base, "en", "p", len(base)),
        (9002, base.replace("word60 ", "other "), "en", "q", len(base)),
        (9003, base, "en", "q", len(base)),
        (9004, " ".join(f"term{i}" for i in range(50)), "en", "p", 1),
        (9005, f"before it {item} and after it", "en", "p", 1),
        (9006, f"here is password = abcdefgh12345678 and {'a1' * 20} ends", "en", "p", 1),
        (9007, None, None, None, None),
        (9008, "", "en", "p", 0),
        (9009, " ".join(f"long{i}" for i in range(60_000)), "en", "r", 1),
    ]
    spark.createDataFrame([tuple(r) for r in rows] + more, docs.schema).write.parquet(f"{where}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    return where


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r.doc_id), r.doc_id)
    return [r for i, r in enumerate(rows) if first[find(i)] == r.doc_id]


def occurs(item, text):
    """Whether some stretch of the text is within 5 % edits of the item: the plain dynamic programme."""
    column = np.arange(len(item) + 1)
    letters, k = np.frombuffer(item.encode("utf-32-le"), np.int32), len(item) * 5 // 100
    for c in text:
        new = np.r_[0, np.minimum(column[:-1] + (letters != ord(c)), column[1:] + 1)]
        column = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if column[-1] <= k:
            return True
    return False


def redacted(text):
    hits = sorted(m.span() for r in secrets.RULES for m in re.finditer(r.full, text, re.ASCII) if (r.accept is None or r.accept(m.group())) and (r.kind != "hex" or len(m.group()) >= 16))
    for a, b in reversed(hits):
        text = text[:a] + "\0" * (b - a) + text[b:]
    return re.sub("\0+", "<secret>", text)


def test_run_is_what_the_plain_stages_give(spark, fixture):
    docs, labels = (spark.read.parquet(f"{fixture}/{t}.parquet") for t in ("documents", "labels"))
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{fixture}/benchmark.parquet").collect()]
    model = toxicity.train(docs, labels)
    rows = one_of_each([r for r in docs.collect() if model.score(r.text or "") < toxicity.THRESHOLD])
    # An item has no chance where few of its letter triples occur, so only the others are compared in full.
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    kept = []
    for r in rows:
        text = " ".join((r.text or "").lower().split())
        have = grams(text)
        if not any(len(g & have) >= len(g) - 3 * (len(item) * 5 // 100) and occurs(item, text) for item in items for g in [grams(item)]):
            kept.append(r)
    found = corpus_pipeline.run(spark, fixture).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in kept}
    assert 9005 not in {r.doc_id for r in kept} and not {9002, 9003} & {r.doc_id for r in kept}
    tokens = Counter()
    for r in found:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({r.doc_id: len(re.findall(r"[^ \t\n\x0b\f\r]+", redacted(r.text or ""))) for r in kept})
    used = Counter()
    for r in found:
        used[r.bin] += r.n_tokens
    assert max(used.values()) <= packing.ROOM
    source = {r.doc_id: r.source for r in kept}
    held = Counter((r.bin, source[r.doc_id]) for r in found if source[r.doc_id] is not None)
    assert max(held.values()) == 1


def test_stages_keep_the_columns_and_take_empty_tables(spark, fixture):
    docs = spark.read.parquet(f"{fixture}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.where("false"), fixture)
        assert out.columns == docs.columns, name
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), fixture).count() == 0


def test_stages_hand_few_whole_texts_to_a_worker_at_once(spark, tmp_path, monkeypatch):
    docs = spark.range(1_300).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")).coalesce(1)
    for table in ("labels", "benchmark"):
        docs.limit(0).write.parquet(f"{tmp_path}/{table}.parquet")

    def sizes(frames):
        for frame in frames:
            yield frame.assign(text=str(len(frame)))

    whole = lambda docs, *rest: docs.mapInPandas(sizes, docs.schema)
    monkeypatch.setattr(corpus_pipeline.toxicity, "drop_toxic", whole)
    monkeypatch.setattr(corpus_pipeline.decontam, "drop_leaking", whole)
    monkeypatch.setattr(corpus_pipeline.secrets, "redact", whole)
    for stage in (corpus_pipeline.no_toxic, corpus_pipeline.no_benchmarks, corpus_pipeline.no_secrets):
        assert {r.text for r in stage(spark, docs, str(tmp_path)).select("text").distinct().collect()} == {"500", "300"}

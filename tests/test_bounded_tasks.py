"""What Python tasks hold and postings count, whatever a table's size."""

import pyarrow as pa
from pyspark.sql import functions as F

from tracelode.operators import blobs, index
from tracelode.operators.index import Index


def test_postings_are_lists_far_fewer_than_trigrams_of_rows(spark, tmp_path):
    rows = spark.range(400).select("id", F.lit("é𝄞 one two three four five six").alias("body"))
    built = Index(spark, f"file://{tmp_path}/i", "id", ("body",)).build(rows)
    counts = {r.gram: r.n for r in built.gram_counts().collect()}
    assert set(counts.values()) == {400} and {"é𝄞 ", "𝄞 o"} <= set(counts)
    assert spark.read.parquet(f"{tmp_path}/i/grams").count() < 400 * len(counts) / 10


def test_trigrams_are_given_on_before_all_are_held(monkeypatch):
    monkeypatch.setattr(index, "LETTERS", 50)
    batch = pa.RecordBatch.from_pydict({"id": list(range(100)), "texts": [["abcdefghij", "ab", f"{n:05d}"] for n in range(100)]})
    given = list(index._grams(iter([batch])))
    assert len(given) > 10 and max(b.num_rows for b in given) < 70
    ids = {}
    for b in given:
        for code, some in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids.setdefault(code, []).extend(some)
    assert ids[ord("a") << 42 | ord("b") << 21 | ord("c")] == list(range(100))


def test_a_sweep_hands_on_few_blobs_at_once(spark, monkeypatch):
    seen, write = [], blobs.cut_lineage
    monkeypatch.setattr(blobs, "cut_lineage", lambda df: seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or write(df))
    a, b = "a1" * 32, "b2" * 32
    rows = [(blobs.BLOB + a, bytes.fromhex(b)), (blobs.BLOB + b, b"x"), ("agentKv:checkpoint:1", b"oaGhoaGhoaGhoaGhoaGhoaGhoaGhoaGhoaGhoaGhoaE=")]
    assert {r.id for r in blobs.live(spark.createDataFrame(rows, "key string, value binary")).collect()} == {a, b}
    assert max(seen) <= 256 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 256

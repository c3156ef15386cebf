"""Searches of the written index against looks at every text."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import search
from tracelode.operators.index import Index, stamp

COLUMNS = ("title", "body")


def rows_of(seed, first, n):
    rng = random.Random(seed)
    parts = ["the", "Ent", "été", "ÉTÉ ", "Straße", "ΑΣ", "ας", "İs", "a-b", "10%", " ", "\n", "x"]
    text = lambda: "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))
    return [(first + i, rng.choice([None, text()]), text()) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/docs"
    schema = "id long, title string, body string"
    index = Index(spark, path, "id", COLUMNS)
    assert not index.complete()
    index.build(spark.createDataFrame(rows_of(1, 0, 300), schema))
    index.append(spark.createDataFrame(rows_of(2, 250, 200), schema))  # ids below 300 are in already
    assert index.complete()
    return index, spark.createDataFrame(rows_of(1, 0, 300) + rows_of(2, 250, 200)[50:], schema).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("query", ["the", "thee", "Ent", "ete", "été t", "traß", "ΑΣ", "ασ", "a-b", "10%", "is", "\n x", "zzz", "the ent ete", "xx"])
def test_searches_equal_a_look_at_every_text(index, query):
    found, rows = index
    if len(query.strip()) >= 2:
        assert ids(found.literal(query, "body")) == ids(rows.where(search.find(F.col("body"), query.strip()) > 0))
    assert ids(found.registry(query, COLUMNS, ("title",))) == ids(search.registry_search(rows, query, COLUMNS, ("title",)))


def test_counts_of_trigrams(index):
    found, rows = index
    want = {}
    for r in rows.collect():
        for g in {t[i : i + 3] for t in ((r.title or "").lower().replace("ς", "σ"), r.body.lower().replace("ς", "σ")) for i in range(len(t) - 2)}:
            want[g] = want.get(g, 0) + 1
    assert {r.gram: r.n for r in found.gram_counts().collect()} == want


def test_a_search_reads_buckets_and_candidates_only(spark, tmp_path, capsys):
    rows = spark.range(20_000).select("id", F.lit("t").alias("title"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.when(F.col("id") % 5_000 == 7, "needle").otherwise("")).alias("body"))
    index = Index(spark, f"file://{tmp_path}/i", "id", COLUMNS).build(rows)
    found = index.literal("eedl", "body")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(id, [" in plan and plan.count(") Scan parquet") == 1
    index.by_grams("eedl").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "gram" in plan and "body" not in plan
    assert ids(found) == [7, 5_007, 10_007, 15_007]


def test_many_candidates_and_changed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tracelode.operators.index.LISTED", 3)
    rows = spark.createDataFrame([(i, None, "abcd" if i % 2 else "") for i in range(20)], "id long, title string, body string")
    assert ids(Index(spark, f"file://{tmp_path}/i", "id", COLUMNS).build(rows).literal("bcd", "body")) == list(range(1, 20, 2))
    rows.write.parquet(f"{tmp_path}/t")
    before = stamp(spark.read.parquet(f"{tmp_path}/t"))
    assert before == stamp(spark.read.parquet(f"{tmp_path}/t"))
    rows.write.mode("append").parquet(f"{tmp_path}/t")
    assert before != stamp(spark.read.parquet(f"{tmp_path}/t"))


def test_an_empty_index(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, title string, body string")
    index = Index(spark, f"file://{tmp_path}/i", "id", COLUMNS).build(rows)
    assert index.rows().count() == index.gram_counts().count() == index.literal("the", "body").count() == index.registry("the", COLUMNS, ("title",)).count() == 0

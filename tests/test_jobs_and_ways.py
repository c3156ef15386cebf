"""Long ways by doubling, places by ranges, runs over several batches, jobs that are polled."""

import time

from pyspark.sql import functions as F

from tracelode.jobs import Polled
from tracelode.operators import graph as G
from tracelode.operators.order import placed
from tracelode.streaming import live as L


def test_a_way_of_hundreds_takes_few_steps(spark, monkeypatch):
    steps = []
    kept = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: steps.append(1) or kept(df))
    nodes = spark.range(1, 301).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"))
    got = {r.id: r.depth for r in G.active_path(nodes, nodes.where("id in (300, 40)").select("id")).collect()}
    assert got == {i: 40 - i if i <= 40 else 300 - i for i in range(1, 301)}
    assert len(steps) <= 2 + 2 * 10


def test_doubling_ends_on_cycles_and_equals_the_frontier(spark):
    rows = [(1, 3), (2, 1), (3, 2), (4, 3), (5, 4), (6, None), (7, 6), (7, 5), (None, 2), (9, 9)]
    nodes = spark.createDataFrame(rows, "id long, parent long")
    for seeds in ([1], [6, 4], [9], [77]):
        s = spark.createDataFrame([(i,) for i in seeds], "id long")
        assert sorted(map(tuple, G.doubled(nodes, s).collect())) == sorted(map(tuple, G.descendants(nodes, s).collect()))


def test_places_by_ranges(spark):
    rows = spark.range(5_000).select((F.pmod(F.xxhash64("id"), F.lit(700))).alias("v"), "id").withColumn("v", F.when(F.col("id") % 9 > 0, F.col("v")))
    got = placed(rows.repartition(7), F.desc_nulls_last("v"), F.asc("id")).collect()
    want = sorted(((r.v, r.id) for r in rows.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, 5_001))
    assert placed(rows.limit(0), "v", "id").count() == 0


def test_runs_go_on_over_batches(spark, tmp_path):
    schema = "key string, line_no long, kind string, text string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = L.joined_chunks(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.key, r.first, r.kind, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(("a", 0, "x", "he"), ("a", 1, "x", "ll"), ("b", 0, "y", "one"), ("b", 1, "x", None)) == [("b", 0, "y", "one")]
    # Line 1 of a comes again; a row without a kind ends the run of b.
    assert run(("a", 1, "x", "ll"), ("a", 2, "x", "o"), ("a", 3, "y", "?"), ("b", 2, None, "end"), ("b", 3, "y", "open")) == [("a", 0, "x", "hello"), ("b", 0, "y", "one"), ("b", 1, "x", "")]


def test_a_job_tells_its_progress_and_can_be_called_off(spark):
    job = Polled(spark, lambda: spark.range(100).repartition(4).count())
    assert job.wait(60) == "done" and job.result == 100
    done, known = job.progress()
    assert 0 < done <= known

    def slowly(batches):
        for b in batches:
            time.sleep(60)
            yield b

    job = Polled(spark, lambda: spark.range(4).mapInPandas(slowly, "id long").count())
    end = time.time() + 30
    while not job.progress()[1] and time.time() < end:
        time.sleep(0.1)
    assert job.state == "running"
    job.cancel()
    assert job.wait(30) == "cancelled"
    assert spark.range(3).count() == 3

    job = Polled(spark, lambda: spark.sql("select raise_error('no')").collect())
    assert job.wait(60) == "failed" and job.error is not None

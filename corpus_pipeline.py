"""A training-corpus pipeline of five stages over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import decontam, packing, secrets, simhash, toxicity
from tracelode.llm.common import TEXTS, batches_of, stash


def in_small_batches(spark: SparkSession, make, tag: str) -> DataFrame:
    """What make() returns, written and read back, with few whole texts at once in a Python worker.

    A worker keeps the memory of its largest batch for the stages after it.
    """
    with batches_of(spark, TEXTS):
        return stash(make(), tag)


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go."""
    return in_small_batches(spark, lambda: toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "toxicity")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return stash(simhash.keep_one(docs), "simhash")


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs, with edits or without, go."""
    return in_small_batches(spark, lambda: decontam.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "decontamination")


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; every document stays."""
    return in_small_batches(spark, lambda: secrets.redact(docs), "secrets")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into bins of tokens, a row a piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", no_toxic),
    ("simhash", no_near_copies),
    ("decontamination", no_benchmarks),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: No stage but the last two could be put in SQL, so tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each but the last writes its result to the shared folder for the next to read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of one or two longs that are sent to every task at most.
BROADCAST_ROWS = 500_000
#: Whole texts in a batch of a Python worker.
TEXTS = 500


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset and driver and executors are one machine (tests, a
    laptop) a local folder takes its place, and it is then set on the context so
    that checkpoint() agrees with it. On a cluster it has to be set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs run inside, so that long texts and what is made of them stay small in a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage as checkpoint() does, but computes df once. A lost
    executor costs nothing: the files are on storage that all of them reach.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def forget(*stashed: DataFrame) -> None:
    """Delete the files of stashed tables that nothing reads any more.

    Only for tables whose readers have been stashed themselves, so that no lost
    task can ask for them again.
    """
    for df in stashed:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder).getParent()
            if path.getName().startswith("stash-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def among(df: DataFrame, keys: DataFrame, on, how: str = "left_semi") -> DataFrame:
    """df's rows whose key is among the keys (or, with left_anti, isn't).

    The keys are counted first: up to BROADCAST_ROWS of them go to every task,
    so that df needs no shuffle; more are joined by a shuffle.
    """
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

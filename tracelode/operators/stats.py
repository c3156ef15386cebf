"""Statistics over session rows: filter, totals, series, mixes, heat map.

A session row has provider, id, cwd, model, reasoning_effort, archived,
tokens_used, created_at and updated_at, times in epoch seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import day_start, hour_of, week_start, weekday
from ..session import cut_lineage


def filter_sessions(s: DataFrame, start: int | None = None, end: int | None = None, cwds: Sequence[str] = (), archived: bool = False) -> DataFrame:
    """Archived rows only on demand, updated_at from start to end, both included; no cwds means all."""
    if not archived:
        s = s.where(~F.col("archived"))
    if start is not None:
        s = s.where(F.col("updated_at") >= start)
    if end is not None:
        s = s.where(F.col("updated_at") <= end)
    return s.where(F.col("cwd").isin(*cwds)) if cwds else s


def kpi(s: DataFrame) -> DataFrame:
    """One row; the average is 0.0 without sessions, an empty cwd is no project."""
    tokens = F.coalesce(F.sum("tokens_used"), F.lit(0))
    return s.agg(
        F.count("*").alias("sessions"),
        tokens.cast("long").alias("tokens"),
        F.countDistinct(F.when(F.col("cwd") != "", F.col("cwd"))).alias("projects"),
        F.coalesce(F.avg("tokens_used"), F.lit(0.0)).alias("avg_tokens"),
    )


def timeseries(s: DataFrame, bucket: str = "day") -> DataFrame:
    """Sessions and tokens by UTC day or Monday week; empty buckets are absent."""
    start = {"day": day_start, "week": week_start}[bucket](F.col("updated_at"))
    return s.groupBy(start.alias("bucket_start")).agg(F.count("*").alias("sessions"), F.sum("tokens_used").cast("long").alias("tokens"))


def by_project(s: DataFrame, limit: int) -> DataFrame:
    """The projects with most sessions, then most tokens, then the least key."""
    found = s.groupBy("provider", "cwd").agg(F.count("*").alias("sessions"), F.sum("tokens_used").cast("long").alias("tokens"))
    return found.orderBy(F.desc("sessions"), F.desc("tokens"), "provider", "cwd").limit(limit)


def by_model(s: DataFrame) -> DataFrame:
    """Rows by provider, model and effort; no model is an empty one, no effort a group of its own."""
    return s.groupBy("provider", F.coalesce("model", F.lit("")).alias("model"), "reasoning_effort").agg(F.count("*").alias("sessions"), F.sum("tokens_used").cast("long").alias("tokens"))


def heatmap(rows: DataFrame, seconds: str = "updated_at") -> DataFrame:
    """All 168 hours of a week with their counts; day 0 is Sunday."""
    grid = rows.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    counts = rows.where(F.col(seconds).isNotNull()).groupBy(weekday(F.col(seconds)).alias("day"), hour_of(F.col(seconds)).alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["day", "hour"], "left").select("day", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def peak(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """The row of the greatest value; of several the first in order."""
    return rows.orderBy(F.desc(value), *order).limit(1)


def snapshot(s: DataFrame, limit: int = 10, bucket: str = "day") -> dict[str, DataFrame]:
    """All statistics over one filtered set, which is computed once and written to the shared folder."""
    s = cut_lineage(s)
    return {"kpi": kpi(s), "timeseries": timeseries(s, bucket), "by_project": by_project(s, limit), "by_model": by_model(s), "heatmap": heatmap(s)}


def model_mix(s: DataFrame, top: int = 5) -> DataFrame:
    """The models with most sessions and the rest as others; one more model than that gets its own row."""
    models = s.groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(F.count("*").alias("sessions"), F.sum("tokens_used").cast("long").alias("tokens"))
    all_ = W.partitionBy()  # a row a model: as many as there are models, not sessions
    ranked = models.withColumn("nth", F.row_number().over(all_.orderBy(F.desc("sessions"), F.desc("tokens"), "model"))).withColumn("n", F.count("*").over(all_))
    own = (F.col("nth") <= top) | (F.col("n") == top + 1)
    return ranked.groupBy(F.when(own, F.col("model")).otherwise(F.lit("others")).alias("model"), (~own).alias("is_rest")).agg(F.sum("sessions").alias("sessions"), F.sum("tokens").alias("tokens"))


def project_groups(s: DataFrame) -> DataFrame:
    """By cwd: sessions, tokens and last update."""
    return s.groupBy("cwd").agg(F.count("*").alias("sessions"), F.sum("tokens_used").cast("long").alias("tokens"), F.max("updated_at").alias("last_updated"))


def project_members(s: DataFrame) -> DataFrame:
    """Sessions with their place in their project, newest first; a list column would hold a whole project in a row."""
    return s.select("*", F.row_number().over(W.partitionBy("cwd").orderBy(F.desc("updated_at"), "id")).alias("place"))


def with_log_counts(s: DataFrame, logs: DataFrame, key: str = "id", log_key: str = "id") -> DataFrame:
    """Sessions with the number of their log rows, 0 if none; counted before the join."""
    counts = logs.groupBy(F.col(log_key).alias(key)).agg(F.count("*").alias("logs_count"))
    return s.join(counts, key, "left").withColumn("logs_count", F.coalesce("logs_count", F.lit(0)))

"""Queries of session statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators import stats as S
from ..session import table
from .tables import SESSIONS, sessions

FROM, TO = 820_454_400, 946_684_800
_WEEK = "(updated_at // 86400 - (updated_at // 86400 + 3) % 7) * 86400"
_LIVE = f"with {SESSIONS}, s as (select * from sessions where not archived and updated_at between {FROM} and {TO})"


def _live(spark, d):
    return S.filter_sessions(sessions(spark, d), FROM, TO)


QUERIES = {
    "stats_kpi": lambda spark, d: S.kpi(_live(spark, d)),
    "stats_timeseries_day": lambda spark, d: S.timeseries(_live(spark, d), "day"),
    "stats_timeseries_week": lambda spark, d: S.timeseries(_live(spark, d), "week"),
    "stats_by_project": lambda spark, d: S.by_project(_live(spark, d), 20),
    "stats_by_model": lambda spark, d: S.by_model(_live(spark, d)),
    "stats_heatmap": lambda spark, d: S.heatmap(table(spark, d, "events").select(epoch_seconds(F.col("ts")).alias("updated_at"))),
    "stats_peak_day": lambda spark, d: S.peak(S.timeseries(_live(spark, d), "day"), "tokens", "bucket_start"),
    "stats_peak_heat": lambda spark, d: S.peak(QUERIES["stats_heatmap"](spark, d), "n", "day", "hour"),
    "model_mix_top5_others": lambda spark, d: S.model_mix(sessions(spark, d), 3),
    "project_groups": lambda spark, d: S.project_groups(sessions(spark, d)),
    "project_members": lambda spark, d: S.project_members(sessions(spark, d)).select("cwd", "id", "updated_at", F.col("place").cast("long").alias("place")),
    "log_counts_left": lambda spark, d: S.with_log_counts(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem"), "id", "l_orderkey"),
    "stats_filter_projects": lambda spark, d: S.kpi(S.filter_sessions(sessions(spark, d), cwds=[str(i) for i in range(1, 60)], archived=True)),
}

_DENSE = """select cast(g.day as integer) as day, cast(g.hour as integer) as hour, cast(coalesce(n, 0) as bigint) as n
  from (select i // 24 as day, i % 24 as hour from range(168) t(i)) g left join (select (cast(floor(epoch(ts)) as bigint) // 86400 + 4) % 7 as day, cast(floor(epoch(ts)) as bigint) % 86400 // 3600 as hour, count(*) as n from events group by 1, 2) c on g.day = c.day and g.hour = c.hour"""
_KPI = "select count(*) as sessions, cast(coalesce(sum(tokens_used), 0) as bigint) as tokens, count(distinct nullif(cwd, '')) as projects, coalesce(avg(tokens_used), 0.0) as avg_tokens from s"

ORACLES = {
    "stats_kpi": f"{_LIVE} {_KPI}",
    "stats_timeseries_day": f"{_LIVE} select updated_at // 86400 * 86400 as bucket_start, count(*) as sessions, cast(sum(tokens_used) as bigint) as tokens from s group by 1",
    "stats_timeseries_week": f"{_LIVE} select {_WEEK} as bucket_start, count(*) as sessions, cast(sum(tokens_used) as bigint) as tokens from s group by 1",
    "stats_by_project": f"{_LIVE} select provider, cwd, count(*) as sessions, cast(sum(tokens_used) as bigint) as tokens from s group by 1, 2 order by 3 desc, 4 desc, 1, 2 limit 20",
    "stats_by_model": f"{_LIVE} select provider, coalesce(model, '') as model, reasoning_effort, count(*) as sessions, cast(sum(tokens_used) as bigint) as tokens from s group by 1, 2, 3",
    "stats_heatmap": _DENSE,
    "stats_peak_day": f"{_LIVE} select updated_at // 86400 * 86400 as bucket_start, count(*) as sessions, cast(sum(tokens_used) as bigint) as tokens from s group by 1 order by 3 desc, 1 limit 1",
    "stats_peak_heat": f"select * from ({_DENSE}) order by n desc, day, hour limit 1",
    "model_mix_top5_others": f"""with {SESSIONS}, m as (select model, count(*) as sessions, sum(tokens_used) as tokens from sessions group by 1),
      r as (select *, row_number() over (order by sessions desc, tokens desc, model) as nth, count(*) over () as n from m)
      select case when nth <= 3 or n = 4 then model else 'others' end as model, not (nth <= 3 or n = 4) as is_rest, cast(sum(sessions) as bigint) as sessions, cast(sum(tokens) as bigint) as tokens from r group by 1, 2""",
    "project_groups": f"with {SESSIONS} select cwd, count(*) as sessions, cast(sum(tokens_used) as bigint) as tokens, max(updated_at) as last_updated from sessions group by 1",
    "project_members": f"with {SESSIONS} select cwd, id, updated_at, row_number() over (partition by cwd order by updated_at desc, id) as place from sessions",
    "log_counts_left": "select o_orderkey as id, count(l_orderkey) as logs_count from orders left join lineitem on o_orderkey = l_orderkey group by 1",
    "stats_filter_projects": f"with {SESSIONS}, s as (select * from sessions where cast(cwd as bigint) between 1 and 59) {_KPI}",
}

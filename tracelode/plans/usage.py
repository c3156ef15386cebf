"""Queries of token usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import SAFE
from ..operators import usage as U
from .tables import PRICE, RATES, SESSIONS, TOKENS, USAGE, prices, sessions, usage

_WITH = f"with {USAGE}, {PRICE}"
_SUMS = ", ".join(f"cast(sum({t}) as bigint) as {t}" for t in TOKENS)
_PAIRS = (("input", "r_input"), ("output", "r_output"), ("cache_read", "r_cache_read"), ("greatest(0, cache_write - cache_write_1h)", "r_write_5m"), ("cache_write_1h", "r_write_1h"))
_BAD = "(" + " or ".join([f"{t} < 0 or {t} > {SAFE}" for t in TOKENS] + ["cache_write_1h > cache_write", "reasoning > output"]) + ")"
_MICRO = f"case when {_BAD} then 0.0 else cast(" + " + ".join(f"coalesce({t} * cast({r} as double), 0.0)" for t, r in _PAIRS) + " as double) end"
_UNKNOWN = f"case when {_BAD} then 5 else " + " + ".join(f"case when {t} > 0 and {r} is null then 1 else 0 end" for t, r in _PAIRS) + " end"
_TOTAL = "input + output + cache_read + cache_write"


def _merged(by: str, where: str = "true") -> str:
    return f"(select {by}, {_SUMS} from usage where {where} group by all)"


def _priced(by: str, where: str = "true") -> str:
    return f"(select m.*, {_MICRO} as micro, {_UNKNOWN} as unknown, {_BAD} as bad from {_merged(by, where)} m left join price using (provider, model))"


_FIGURES = f"""count(distinct (provider, session)) as sessions, {_SUMS}, coalesce(sum(micro), 0.0) / 1000000 as known,
  cast(coalesce(sum(case when unknown > 0 then 1 else 0 end), 0) as bigint) as unknown_models, coalesce(bool_or(bad), false) as overflow"""
_DATED = "date is not null"


_QUALITY = "select 1 as missing_sessions, (select count(distinct (provider, session)) from usage where session % 7 = 0) as warned_sessions"


def _comparison(days: int, rows: str = "true") -> str:
    cur, prev = (days - 1, 0), (2 * days - 1, days)
    when = "case " + " ".join(f"when date between strftime(date '2024-01-30' - {a}, '%Y-%m-%d') and strftime(date '2024-01-30' - {b}, '%Y-%m-%d') then '{n}'" for n, (a, b) in (("current", cur), ("previous", prev))) + " end"
    u = f"usage as (select *, {when} as period from raw_usage where {rows})"
    return f"""with {USAGE.replace("usage as", "raw_usage as", 1)}, {PRICE}, {u},
      s as (select period, {_FIGURES} from {_priced("period, provider, session, model", "date is not null and period is not null")} group by period),
      f as (select max(case when period = 'current' then {_TOTAL} end) as current_tokens, max(case when period = 'previous' then {_TOTAL} end) as previous_tokens,
        max(case when period = 'current' then known end) as current_known, max(case when period = 'previous' then known end) as previous_known, cast(coalesce(sum(unknown_models), 0) as bigint) as unknown_models, coalesce(bool_or(overflow), false) as overflow from s),
      l as (select count(distinct (provider, session)) as undated_sessions from usage where WHERE_LOOSE),
      o as (select coalesce(bool_or(bad), false) as scope_overflow from {_priced("provider, session, model")}),
      q as (QUALITY),
      r as (select *, concat_ws('; ', case when warned_sessions > 0 then 'sessions with warnings' end, case when missing_sessions > 0 then 'sessions without usage' end, case when undated_sessions > 0 then 'undated usage' end, case when overflow or scope_overflow then 'beyond exact numbers' end, case when current_tokens is null or previous_tokens is null then 'a period has no usage' end) as reasons from f, l, o, q)
      select current_tokens, previous_tokens, current_known, previous_known, undated_sessions, missing_sessions, warned_sessions, reasons,
        case when reasons = '' then current_tokens - previous_tokens end as tokens_delta,
        case when reasons = '' and previous_tokens <> 0 then (current_tokens - previous_tokens) / previous_tokens * 100 when reasons = '' and current_tokens = 0 then 0.0 end as tokens_percent,
        case when reasons = '' then current_known - previous_known end as known_delta,
        case when unknown_models = 0 and reasons = '' and previous_known <> 0 then (current_known - previous_known) / previous_known * 100 when unknown_models = 0 and reasons = '' and current_known = 0 then 0.0 end as known_percent
      from r"""


def _rank(by: str, key: str, value: str) -> str:
    return f"""{_WITH}, g as (select {by}, {_FIGURES} from {_priced("provider, session, cwd, model")} group by {by}),
      r as (select *, {key} as key, case when not overflow then {_TOTAL} end as total from g)
      select row_number() over (order by (total is null)::int, case when total is not null then {value} end desc nulls last, key) as place, key, sessions, total, known from r"""


def _fields(test) -> str:
    names = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
    return "concat_ws(',', " + ", ".join(f"case when {test(n, r)} then '{n}' end" for n, (_, r) in zip(names, _PAIRS, strict=True)) + ")"


def _clean(spark, d):
    """The dated and sound rows alone, so that periods can be compared."""
    return usage(spark, d).where("date is not null and cache_write_1h <= cache_write")


def _listed(spark, d):
    """All sessions with usage and one without; each seventh has a warning."""
    seen = usage(spark, d).select("provider", "session").distinct()
    return seen.unionByName(spark.createDataFrame([("p9", -1)], seen.schema)).withColumn("warned", F.col("session") % 7 == 0)


def _other_book(spark):
    rows = [("p0", "click", 3.0, None, None, 3.75, 6.0), ("p0", "view", 9.0, 2.0, None, 1.25, 2.0), ("p1", "view", None, None, 0.75, None, None), ("p1", "fresh", 1.0, None, None, None, None)]
    return spark.createDataFrame(rows, prices(spark).schema)


_LOOKUP = "left join (select provider, cwd, min(id) as id from sessions group by 1, 2 having count(*) = 1) using (provider, cwd)"

QUERIES = {
    "usage_summary": lambda spark, d: U.usage_summary(usage(spark, d), prices(spark), _listed(spark, d)),
    "usage_by_model": lambda spark, d: U.usage_by(usage(spark, d), prices(spark), "model"),
    "usage_by_project": lambda spark, d: U.usage_by(usage(spark, d), prices(spark), "project"),
    "usage_daily": lambda spark, d: U.usage_daily(usage(spark, d)),
    "usage_undated": lambda spark, d: U.undated(usage(spark, d)),
    "usage_daily_trend": lambda spark, d: U.daily_trend(usage(spark, d), prices(spark)),
    "usage_in_dates": lambda spark, d: U.usage_summary(U.in_dates(usage(spark, d), "2024-01-05", "2024-01-20"), prices(spark)),
    "usage_period_comparison": lambda spark, d: U.period_comparison(_clean(spark, d), prices(spark), "2024-01-30", 7),
    "usage_period_suppressed": lambda spark, d: U.period_comparison(usage(spark, d), prices(spark), "2024-01-30", 30, _listed(spark, d)),
    "usage_rank_model": lambda spark, d: U.rank(usage(spark, d), prices(spark), "model"),
    "usage_rank_project": lambda spark, d: U.rank(usage(spark, d), prices(spark), "project", "cost"),
    "price_catalog": lambda spark, d: U.price_catalog(usage(spark, d), prices(spark)),
    "usage_cost_status": lambda spark, d: U.usage_by(usage(spark, d), prices(spark), "model").select("provider", "model", U.cost_status(F.lit(True), F.col("overflow"), F.col("unknown_models")).alias("cost_status")),
    "usage_session_lookup": lambda spark, d: U.unique_match(sessions(spark, d).select("provider", "cwd", "updated_at"), sessions(spark, d), ["provider", "cwd"]),
    "dedup_first_wins": lambda spark, d: U.first_wins(usage(spark, d), ["provider", "date"], "event_id").select("provider", "date", "event_id", "model"),
    "dedup_last_wins": lambda spark, d: U.last_wins(usage(spark, d), ["provider", "date"], "event_id").select("provider", "date", "event_id", "place"),
    "price_merge": lambda spark, d: U.merge_books(prices(spark), _other_book(spark)),
}

ORACLES = {
    "usage_summary": f"{_WITH} select * from (select {_FIGURES} from {_priced('provider, session, model')}), ({_QUALITY})",
    "usage_by_model": f"{_WITH} select provider, model, {_FIGURES} from {_priced('provider, session, cwd, model')} group by provider, model",
    "usage_by_project": f"{_WITH} select cwd, {_FIGURES} from {_priced('provider, session, cwd, model')} group by cwd",
    "usage_daily": f"with {USAGE} select * from {_merged('provider, session, date, model')}",
    "usage_undated": f"with {USAGE} select * from {_merged('provider, session, model', 'date is null')}",
    "usage_daily_trend": f"{_WITH}, s as (select date, {_FIGURES} from {_priced('provider, session, date, model', _DATED)} group by date) select date, sessions, {_TOTAL} as tokens, known, unknown_models, overflow or unknown_models > 0 as incomplete from s",
    "usage_in_dates": _WITH + f" select {_FIGURES} from " + _priced("provider, session, model", "date between '2024-01-05' and '2024-01-20'"),
    "usage_period_comparison": _comparison(7, "date is not null and cache_write_1h <= cache_write").replace("WHERE_LOOSE", "false").replace("QUALITY", "select 0 as missing_sessions, 0 as warned_sessions"),
    "usage_period_suppressed": _comparison(30).replace("WHERE_LOOSE", "date is null").replace("QUALITY", _QUALITY),
    "usage_rank_model": _rank("provider, model", """'["' || provider || '","' || model || '"]'""", _TOTAL),
    "usage_rank_project": _rank("cwd", "coalesce(cwd, '')", "known"),
    "price_catalog": f"""{_WITH}, r as (select *, {_BAD} as bad from {_merged("provider, session, model")}),
      u as (select provider, model, count(distinct (provider, session)) as sessions, bool_or(bad) as invalid_usage, {", ".join(f"coalesce(max(case when not bad then {t} > 0 end), false) as u_{r}" for t, r in _PAIRS)} from r group by provider, model)
      select coalesce(u.provider, price.provider) as provider, coalesce(u.model, price.model) as model, coalesce(sessions, 0) as sessions, coalesce(invalid_usage, false) as invalid_usage, {_fields(lambda n, r: f"u_{r}")} as used_fields, {_fields(lambda n, r: f"u_{r} and {r} is null")} as missing_fields from u full join price on u.model = price.model and u.provider = price.provider""",
    "usage_cost_status": f"{_WITH}, s as (select provider, model, {_FIGURES} from {_priced('provider, session, cwd, model')} group by provider, model) select provider, model, case when overflow then 'overflow' when unknown_models > 0 then 'partial_known_only' else 'known' end as cost_status from s",
    "usage_session_lookup": f"with {SESSIONS} select provider, cwd, updated_at, m.id as id from (select provider, cwd, updated_at from sessions) s {_LOOKUP.replace('left join (', 'left join (').replace(') using', ') m using')}",
    "dedup_first_wins": f"with {USAGE} select provider, date, event_id, model from usage qualify row_number() over (partition by provider, date order by event_id) = 1",
    "dedup_last_wins": f"with {USAGE} select provider, date, event_id, min(event_id) over (partition by provider, date) as place from usage qualify row_number() over (partition by provider, date order by event_id desc) = 1",
    "price_merge": f"with {PRICE}, o as (select * from (values ('p0', 'click', 3.0, null, null, 3.75, 6.0), ('p0', 'view', 9.0, 2.0, null, 1.25, 2.0), ('p1', 'view', null, null, 0.75, null, null), ('p1', 'fresh', 1.0, null, null, null, null)) as t(provider, model, {', '.join(RATES)})) select coalesce(o.provider, p.provider) as provider, coalesce(o.model, p.model) as model, "
    + ", ".join(f"cast(coalesce(o.{r}, p.{r}) as double) as {r}" for r in RATES)
    + ", case when o.model is null then 'kept' when p.model is null then 'added' when "
    + " and ".join(f"(o.{r} is null or o.{r} is not distinct from p.{r})" for r in RATES)
    + " then 'same' else 'changed' end as change from o full join price p on o.model = p.model and o.provider = p.provider",
}

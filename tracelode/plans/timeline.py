"""Queries of transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators import timeline as L
from ..session import table
from .tables import TRANSCRIPT, transcript


def _phased(spark, d):
    phase = F.when((F.col("role") == "assistant") & (F.col("session") % 2 == 0), F.when(F.col("idx") % 4 == 1, "final_answer").otherwise("commentary"))
    return transcript(spark, d).withColumn("phase", phase)


_T = f"with {TRANSCRIPT}"
_P = f"""{_T}, p as (select *, case when role = 'assistant' and session % 2 = 0 then case when idx % 4 = 1 then 'final_answer' else 'commentary' end end as phase,
  cast(sum((role = 'user')::int) over (partition by session order by idx) as bigint) as turn from transcript)"""
_ANSWER = "case when max(case when role = 'assistant' and phase is not null then 1 end) {o} = 1 then max(case when role = 'assistant' and phase = 'final_answer' then idx end) {o} else max(case when role = 'assistant' then idx end) {o} end"


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), F.when(F.col("event_id") % 11 != 0, epoch_seconds(F.col("ts"))).alias("at"), F.col("event_type").alias("role"), F.col("event_type").alias("text"), F.get_json_object("props", "$.k").cast("long").alias("total"))


_E = "with e as (select user_id as session, event_id as idx, case when event_id % 11 <> 0 then cast(floor(epoch(ts)) as bigint) end as tm, event_type as role, event_type as text, cast(json_extract(props, '$.k') as bigint) as total from events)"
_NEW = "select *, coalesce((role <> lag(role) over (partition by session order by idx))::int, 1) as new from e"


def _pairs(spark, d):
    """Conversation 2n against 2n + 1, roles only."""
    t = transcript(spark, d).select(F.floor(F.col("session") / 2).alias("pair"), (F.col("session") % 2).alias("side"), F.col("idx").alias("line"), "role")
    a = t.where("side = 0").select("pair", "line", F.col("role").alias("active"))
    b = t.where("side = 1").select("pair", "line", F.col("role").alias("branch"))
    return a.join(b, ["pair", "line"], "full_outer")



def _branching(spark, d):
    """Logs some of which lack a head, a line or the cut, or have a bad line."""
    t, n = transcript(spark, d), F.col("session")
    outer = F.when((F.col("idx") == 0) & (n % 4 > 0), "session_meta").when(F.col("idx") % 2 == 0, "event_msg").otherwise("response_item")
    kind = F.when(F.col("idx") % 2 == 1, "message").when(F.col("role") == "user", "user_message").otherwise("token_count")
    rows = t.select("session", "idx", ((n % 7 == 6) & (F.col("idx") == 1)).alias("bad"), outer.alias("outer"), kind.alias("kind"), "role")
    return L.prefix_problems(rows, t.select("session").distinct().select("session", (n % 6).cast("long").alias("cut")))


QUERIES = {
    "branch_problems": _branching,
    "turn_segments": lambda spark, d: L.turns(transcript(spark, d)).select("session", "idx", "turn"),
    "turn_phases": lambda spark, d: L.assign_phases(transcript(spark, d)).select("session", "idx", "phase"),
    "turn_final_answer": lambda spark, d: L.final_answers(_phased(spark, d)),
    "conversation_display": lambda spark, d: L.display(_phased(spark, d)).select("session", "idx", "role"),
    "prompt_timeline": lambda spark, d: L.prompt_timeline(_phased(spark, d)),
    "message_time_range": lambda spark, d: L.in_time(_events(spark, d), 1_704_500_000, 1_705_500_000).select("session", "idx"),
    "export_inclusion": lambda spark, d: L.inclusion(transcript(spark, d), F.col("role") == "user", F.col("idx") % 3 == 0).select("session", "idx", "included"),
    "search_gaps": lambda spark, d: L.search_gaps(transcript(spark, d), F.contains(F.lower("text"), F.lit("th"))).select("session", "idx", F.col("hidden").cast("long").alias("hidden")),
    "last_writer_wins": lambda spark, d: L.latest(_events(spark, d), "session", "text", "idx"),
    "first_last_by_kind": lambda spark, d: L.ends(transcript(spark, d), 1, 3).select("session", "idx", "role"),
    "chunk_coalesce": lambda spark, d: L.coalesce_chunks(_events(spark, d), "role").select("session", "first", "chunks", "role", "text"),
    "prefix_compare": lambda spark, d: L.prefix_compare(_pairs(spark, d)),
    "prefix_to_node": lambda spark, d: L.prefix_to(transcript(spark, d), transcript(spark, d).groupBy("session").agg((F.max("idx") - 1).alias("cut"))).select("session", "idx"),
    "window_chunks": lambda spark, d: L.in_chunks(_events(spark, d)).groupBy("session", "chunk").agg(F.count("*").alias("n"), F.min("idx").alias("first")),
    "message_time_span": lambda spark, d: L.time_span(_events(spark, d)),
    "nearest_mirror": lambda spark, d: L.nearest_mirror(_events(spark, d).withColumn("text", F.col("total") % 5).withColumn("session", F.col("session") % 20), "role", {"view": "click", "click": "view"}).select("session", "idx", "mirror"),
    "counter_delta_epoch": lambda spark, d: L.counter_deltas(_events(spark, d), "session", "idx", "total").select("session", "idx", "delta", "epoch"),
}

ORACLES = {
    "turn_segments": f"{_P} select session, idx, turn from p",
    "turn_phases": f"{_P} select session, idx, case when role = 'assistant' and turn > 0 then case when idx = max(idx) over (partition by session, turn) then 'final_answer' else 'commentary' end end as phase from p",
    "turn_final_answer": f"{_P} select session, turn, {_ANSWER.format(o='')} as answer from p group by 1, 2 having answer is not null",
    "conversation_display": f"{_P} select session, idx, role from p qualify role <> 'assistant' or idx = {_ANSWER.format(o='over (partition by session, turn)')}",
    "prompt_timeline": f"""{_P}, g as (select session, turn, min(case when role = 'user' then idx end) as prompt, max((role <> 'user')::int) as active,
      coalesce(max(case when role = 'assistant' and trim(text) <> '' and phase = 'final_answer' then idx end), max(case when role = 'assistant' and trim(text) <> '' and phase is not null then idx end), max(case when role = 'assistant' and trim(text) <> '' and phase is null then idx end)) as response
      from p where turn > 0 group by 1, 2) select session, turn, prompt, response from g qualify active = 1 or turn = max(turn) over (partition by session)""",
    "message_time_range": f"{_E} select session, idx from e where tm is null or (tm >= 1704500000 and tm < 1705500000)",
    "export_inclusion": f"""{_T} select session, idx, case when role = 'user' then idx % 3 = 0 else coalesce(
      (select t2.idx % 3 = 0 from transcript t2 where t2.session = t.session and t2.role = 'user' and t2.idx > t.idx order by t2.idx limit 1),
      (select t2.idx % 3 = 0 from transcript t2 where t2.session = t.session and t2.role = 'user' and t2.idx < t.idx order by t2.idx desc limit 1), false) end as included from transcript t""",
    "search_gaps": f"{_T}, n as (select *, row_number() over (partition by session order by idx) as p from transcript), v as (select session, idx, p - lag(p) over (partition by session order by idx) - 1 as hidden from n where contains(lower(text), 'th')) select session, idx, hidden from v where hidden > 0",
    "last_writer_wins": f"{_E} select session, arg_max(text, idx) as text from e group by 1",
    "first_last_by_kind": f"{_T} select session, idx, role from transcript qualify row_number() over (partition by session, role order by idx) <= 1 or row_number() over (partition by session, role order by idx desc) <= 3",
    "chunk_coalesce": f"{_E}, r as (select *, sum(new) over (partition by session order by idx) as run from ({_NEW})) select session, min(idx) as first, count(*) as chunks, any_value(role) as role, string_agg(text, '' order by idx) as text from r group by session, run",
    "prefix_compare": f"""{_T}, t as (select session // 2 as pair, session % 2 as side, idx as line, role from transcript),
      j as (select coalesce(a.pair, b.pair) as pair, coalesce(a.line, b.line) as line, a.role as active, b.role as branch from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair = b.pair and a.line = b.line),
      g as (select pair, min(case when active is distinct from branch then line end) as diff, count(active) as na, count(branch) as nb from j where line > 0 group by 1),
      c as (select *, coalesce(diff - 1, greatest(na, nb)) as common from g)
      select pair, common, case when diff is null then 'same' when common = na then 'branch_ahead' when common = nb then 'active_ahead' else 'diverged' end as state,
        case when diff is null then 0 when common = na then nb - na when common = nb then na - nb else 0 end as ahead from c""",
    "branch_problems": f"""{_T}, c as (select distinct session, session % 6 as cut from transcript), f as (select session, bool_or(session % 7 = 6 and idx = 1) as broken, bool_or(idx = cut) as there,
        bool_or(idx = cut and (cut % 2 = 1 and role in ('user', 'assistant') or cut % 2 = 0 and role = 'user' and not (idx = 0 and session % 4 > 0))) as stable, bool_or(idx = 0 and session % 4 > 0) as head from c join transcript t using (session) where idx <= cut group by 1)
      select session, case when coalesce(broken, false) then 'bad line' when not coalesce(there, false) then 'no such line' when not stable then 'no message' when not head then 'no head' end as problem from c left join f using (session)""",
    "prefix_to_node": f"{_T}, c as (select session, max(idx) - 1 as cut from transcript group by 1), s as (select c.* from c join transcript t on t.session = c.session and t.idx = c.cut where role in ('user', 'assistant')) select t.session, t.idx from transcript t join s using (session) where t.idx <= cut",
    "window_chunks": f"{_E}, n as (select session, idx, (row_number() over (partition by session order by idx) - 1) // 40 as chunk from e) select session, chunk, count(*) as n, min(idx) as first from n group by 1, 2",
    "message_time_span": f"{_E} select session, min(tm // 60 * 60) as first, max(tm // 60 * 60) as last, count(distinct tm // 86400) > 1 as several_days from e group by 1",
    "nearest_mirror": f"""{_E}, f as (select session % 20 as session, idx, role, total % 5 as text from e)
      select session, idx, case when role in ('view', 'click') then (select b.idx from f b where b.session = a.session and b.text = a.text and b.role = case a.role when 'view' then 'click' else 'view' end order by abs(b.idx - a.idx), b.idx limit 1) end as mirror from f a""",
    "counter_delta_epoch": f"{_E}, b as (select *, lag(total) over (partition by session order by idx) as before from e) select session, idx, case when before is null or total < before then total else total - before end as delta, cast(sum(coalesce((total < before)::int, 0)) over (partition by session order by idx) as bigint) as epoch from b",
}

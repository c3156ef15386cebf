"""Queries of parent graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deletion, graph as L
from .tables import TRANSCRIPT, transcript


def _nodes(spark, d):
    """Turns hang on the turn before, each fifth on the one two before; some parents are missing."""
    t = transcript(spark, d)
    id_ = lambda turn: F.col("session") * 1000 + turn
    parent = F.when(F.col("idx") == 0, F.lit(None)).when((F.col("session") % 10 == 3) & (F.col("idx") == 2), id_(F.lit(999))).when(F.col("idx") % 5 == 4, id_(F.col("idx") - 2)).otherwise(id_(F.col("idx") - 1))
    return t.select(id_(F.col("idx")).alias("id"), parent.alias("parent"), "session", "idx", "role")


_N = f"""{TRANSCRIPT}, nodes as (select session * 1000 + idx as id, case when idx = 0 then null when session % 10 = 3 and idx = 2 then session * 1000 + 999
  when idx % 5 = 4 then session * 1000 + idx - 2 else session * 1000 + idx - 1 end as parent, session, idx, role from transcript)"""


def _seeds(spark, d):
    return _nodes(spark, d).where("idx = 1 and session % 2 = 0").select("id")


def _tips(spark, d):
    return _nodes(spark, d).groupBy("session").agg(F.max("id").alias("id")).select("id")


def _looped(spark, d):
    """The graph with a cycle of three, a row without id and a repeated one."""
    n = _nodes(spark, d).select("id", "parent")
    more = spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-4, -1), (None, 0), (0, None)], n.schema)
    return n.unionByName(more)


def _log(spark, d):
    """Several rows a turn: context, messages in both forms, thoughts, calls and what they give back."""
    t, none = transcript(spark, d), F.lit(None).cast("string")
    turn, call = F.col("idx"), F.concat(F.lit("c"), "idx")

    def row(nth, when, outer, kind=none, role=none, call=none, text=none):
        return F.when(when, F.struct((turn * 10 + nth).alias("idx"), F.lit(outer).alias("outer"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(role) if isinstance(role, str) else role).alias("role"), call.alias("call"), text.alias("text")))

    user, helper, text = F.col("role") == "user", F.col("role") == "assistant", F.substr("text", F.lit(1), F.lit(40))
    lines = [
        row(0, turn % 7 == 6, "turn_context"),
        row(1, user, "response_item", "message", "user", text=text), row(2, user, "event_msg", "user_message", text=text),
        row(1, helper & (turn % 3 > 0), "response_item", "reasoning"), row(2, helper & (turn % 3 > 1), "response_item", "reasoning"),
        row(3, helper, "response_item", "function_call", call=call), row(4, helper, "response_item", "function_call_output", call=call), row(5, helper, "event_msg", "exec_command_end", call=call),
        row(6, helper, "response_item", "message", "assistant", text=text), row(7, helper, "event_msg", "agent_message", text=text),
        row(1, F.col("role") == "system", "response_item", "message", "system"),
    ]
    return t.select("session", F.explode(F.array_compact(F.array(*lines))).alias("r")).select("session", "r.*")


def _deleted(spark, d):
    rows = _log(spark, d)
    turn, nth = F.floor(F.col("idx") / 10), F.col("idx") % 10
    picked = (turn % 4 == 1) & (nth == 6) | (turn % 5 == 2) & (nth == 3) | (turn % 6 == 4) & (nth == 2) | (F.col("session") % 10 == 9) & (nth == 0)
    missing = rows.where("session % 10 = 8").select("session", F.lit(99_999).cast("long").alias("idx")).distinct()
    return deletion.deletion_closure(rows, rows.where(picked).select("session", "idx").unionByName(missing))


def _tools(spark, d):
    """Each turn uses a tool and holds the result of the turn two before; the first of a session can't go."""
    t = transcript(spark, d)
    of = lambda turn: F.array(F.concat(F.lit("t"), turn))
    rows = t.select("session", "idx", F.when(F.col("idx") % 3 < 2, of(F.col("idx"))).alias("uses"), F.when(F.col("idx") > 1, of(F.col("idx") - 2)).alias("results"), (F.col("idx") > 0).alias("deletable"))
    return deletion.tool_closure(rows, rows.where("idx = 3 or session % 10 = 9 and idx = 0").select("session", "idx"))


_DOWN = "d(id, depth) as ({seed} union select n.id, depth + 1 from nodes n join d on n.parent = d.id)"
_RELINKED = "u(id, parent) as (select id, parent from nodes where idx % 3 <> 1 union all select u.id, n.parent from u join nodes n on u.parent = n.id where n.idx % 3 = 1)"

QUERIES = {
    "descendants": lambda spark, d: L.descendants(_nodes(spark, d), _seeds(spark, d)),
    "roots_leaves": lambda spark, d: L.roots(_nodes(spark, d)).withColumn("kind", F.lit("root")).unionByName(L.leaves(_nodes(spark, d)).withColumn("kind", F.lit("leaf"))),
    "active_path": lambda spark, d: L.active_path(_nodes(spark, d), _tips(spark, d)),
    "graph_problems": lambda spark, d: L.problems(_looped(spark, d)),
    "orphan_closure": lambda spark, d: L.orphans(_nodes(spark, d)),
    "subagent_tree": lambda spark, d: L.ordered_tree(_nodes(spark, d), L.roots(_nodes(spark, d)), "idx"),
    "relink_parents": lambda spark, d: L.relink(_nodes(spark, d), _nodes(spark, d).where("idx % 3 = 1")),
    "deletion_closure": _deleted,
    "tool_closure": _tools,
    "pair_closure": lambda spark, d: L.pair_closure(transcript(spark, d).select((F.col("session") * 1000 + F.col("idx")).alias("row"), F.floor((F.col("session") * 1000 + F.col("idx") * 3) / 4).alias("call")), _seeds(spark, d).withColumnRenamed("id", "row")),
    "cascade_exclusive": lambda spark, d: L.exclusive(L.descendants(_nodes(spark, d), _seeds(spark, d)), L.descendants(_nodes(spark, d), _nodes(spark, d).where("idx = 4").select("id")).select("id")),
}

def _stranded(n: int) -> str:
    """One round of thoughts that are left over, as a table of marked rows."""
    return f"""i{n + 1} as materialized (select session, idx, kind, role, gone or coalesce(kind = 'reasoning' and cut and (next is null or next.kind = 'reasoning' or next.kind = 'message' and next.role = 'user'), false) as gone
      from (select *, lead(gone) over w as cut, first_value(case when not gone then {{'kind': kind, 'role': role}} end ignore nulls) over (partition by session order by idx rows between 1 following and unbounded following) as next from i{n} window w as (partition by session order by idx)))"""


_CLOSURE = f"""with {TRANSCRIPT}, l as (
      select session, idx * 10 + j as idx, outer_ as "outer", kind, who as role, call, case when text_ then substr(text, 1, 40) end as text from transcript,
        (values (0, 'turn_context', null, null, false, false, null), (1, 'response_item', 'message', 'user', false, true, 'user'), (2, 'event_msg', 'user_message', null, false, true, 'user'),
          (1, 'response_item', 'reasoning', null, false, false, 'assistant'), (2, 'response_item', 'reasoning', null, false, false, 'assistant'), (3, 'response_item', 'function_call', null, true, false, 'assistant'), (4, 'response_item', 'function_call_output', null, true, false, 'assistant'),
          (5, 'event_msg', 'exec_command_end', null, true, false, 'assistant'), (6, 'response_item', 'message', 'assistant', false, true, 'assistant'), (7, 'event_msg', 'agent_message', null, false, true, 'assistant'), (1, 'response_item', 'message', 'system', false, false, 'system')) v(j, outer_, kind, who, calls, text_, of_),
        lateral (select case when calls then 'c' || idx end as call)
      where case when of_ is null then idx % 7 = 6 else role = of_ and (kind <> 'reasoning' or idx % 3 >= j) end),
    s as (select session, idx from l where (idx // 10) % 4 = 1 and idx % 10 = 6 or (idx // 10) % 5 = 2 and idx % 10 = 3 or (idx // 10) % 6 = 4 and idx % 10 = 2 or session % 10 = 9 and idx % 10 = 0
      union select session, 99999 from l where session % 10 = 8),
    bad as (select s.session, s.idx from s left join l using (session, idx) where l."outer" is null or l."outer" = 'turn_context'),
    p0 as (select * from s where session not in (select session from bad)),
    p1 as (select session, idx, 'selected' as reason from p0 union all select distinct l.session, l.idx, 'pair' from l join (select l.session, call from l join p0 using (session, idx) where kind in ('function_call', 'function_call_output')) c using (session, call)
      where (l.session, l.idx) not in (select session, idx from p0)),
    f as (select session, idx, text, case when kind = 'message' then 'item ' || role when kind = 'user_message' then 'event user' when kind = 'agent_message' then 'event assistant' end as form from l where text <> ''),
    t as (select a.session, b.idx from f a join p1 using (session, idx) join f b on a.session = b.session and a.text = b.text and split_part(a.form, ' ', 2) = split_part(b.form, ' ', 2) and a.form <> b.form
      qualify row_number() over (partition by a.session, a.idx order by abs(a.idx - b.idx), b.idx) = 1),
    p2 as (select * from p1 union all select distinct session, idx, 'mirror' from t where (session, idx) not in (select session, idx from p1)),
    g as (select l.session, l.idx, kind, role, p2.idx is not null as gone from l left join p2 using (session, idx) where "outer" = 'response_item'),
    k as (select *, sum((not gone and kind <> 'reasoning')::int) over (partition by session order by idx) as part, case when not gone and kind = 'reasoning' then 1 when gone and (kind = 'function_call' or kind = 'message' and role = 'assistant') then -1 else 0 end as step from g),
    u as (select *, sum(step) over (partition by session, part order by idx) as level from k),
    v as (select *, level - least(0, min(level) over (partition by session, part order by idx)) as depth from u),
    i0 as (select session, idx, kind, role, gone or coalesce(step = 1 and min(depth) over (partition by session, part order by idx rows between 1 following and unbounded following) < depth, false) as gone from v),
    {_stranded(0)}, {_stranded(1)}, {_stranded(2)}, {_stranded(3)}"""

_SEED = "select id, 0 from nodes where idx = 1 and session % 2 = 0"
ORACLES = {
    "descendants": f"with recursive {_N}, {_DOWN.format(seed=_SEED)} select id, cast(min(depth) as integer) as depth from d group by 1",
    "roots_leaves": f"with {_N} select id, 'root' as kind from nodes where parent is null union all select id, 'leaf' from nodes where id not in (select parent from nodes where parent is not null)",
    "active_path": f"with recursive {_N}, a(id, depth) as (select max(id), 0 from nodes group by session union select n.parent, depth + 1 from nodes n join a on n.id = a.id where n.parent is not null) select id, cast(min(depth) as integer) as depth from a where id in (select id from nodes) group by 1",
    "graph_problems": f"""with {_N}, g as (select id, parent from nodes union all select * from (values (-1, -2), (-2, -3), (-3, -1), (-4, -1), (null, 0), (0, null)) t(id, parent))
      select id, 'empty id' as problem from g where id is null union all select id, 'repeated id' from g where id is not null group by id having count(*) > 1
      union all select id, 'missing parent' from g where parent is not null and parent not in (select id from g where id is not null) union all select unnest([-1, -2, -3, -4]), 'cycle'""",
    "orphan_closure": f"with recursive {_N}, {_DOWN.format(seed='select id, 0 from nodes where parent is not null and parent not in (select id from nodes)')} select id, cast(min(depth) as integer) as depth from d group by 1",
    "subagent_tree": f"with recursive {_N}, s as (select *, lpad(cast(idx as varchar), 20, '0') || ':' || lpad(cast(id as varchar), 20, '0') as step from nodes), t(id, depth, way) as (select id, 0, step from s where parent is null union all select s.id, depth + 1, way || '/' || step from s join t on s.parent = t.id) select id, cast(depth as integer) as depth, way from t",
    "relink_parents": f"with recursive {_N}, {_RELINKED} select id, parent from u where parent is null or parent not in (select id from nodes where idx % 3 = 1)",
    "deletion_closure": f"""{_CLOSURE} select * from p2 union all select session, idx, 'reasoning' from i4 where gone and (session, idx) not in (select session, idx from p2) union all select session, idx, 'blocked' from bad""",
    "tool_closure": f"""with recursive {TRANSCRIPT}, n as (select session, idx, case when idx % 3 < 2 then idx end as uses, case when idx > 1 then idx - 2 end as results from transcript),
      f(session, idx) as (select session, idx from n where idx = 3 and session % 10 <> 9
        union select b.session, b.idx from f join n a using (session, idx) join n b on a.session = b.session and (a.uses = b.results or a.results = b.uses) where b.idx > 0)
      select session, idx, case when idx = 3 then 'selected' else 'pair' end as reason from f union all select session, idx, 'blocked' from n where session % 10 = 9 and idx = 0""",
    "pair_closure": f"""with recursive {_N}, l as (select session * 1000 + idx as r, (session * 1000 + idx * 3) // 4 as c from transcript),
      f(r) as (select id from nodes where idx = 1 and session % 2 = 0 union select b.r from f join l a on f.r = a.r join l b on a.c = b.c) select r as "row" from f""",
    "cascade_exclusive": f"with recursive {_N}, {_DOWN.format(seed=_SEED)}, k(id, depth) as (select id, 0 from nodes where idx = 4 union select n.id, depth + 1 from nodes n join k on n.parent = k.id) select id, cast(min(depth) as integer) as depth from d where id not in (select id from k) group by 1",
}

"""Queries of diagnosis, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose as L
from ..session import table
from .tables import SESSIONS, sessions


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))


def _logged(spark, d):
    """Ids that line items name, shifted by seven so that some are unknown."""
    return table(spark, d, "lineitem").select((F.col("l_orderkey") + 7).alias("id"))


def _diff(spark, d):
    labels = table(spark, d, "labels").select((F.col("doc_id") + 1).alias("id"))
    return L.set_diff({"threads": _orders(spark, d), "index": labels, "logs": _logged(spark, d)}, [("threads", "logs"), ("index", "threads"), ("logs", "threads"), ("logs", "index")])


def _counts(spark, d):
    logs = table(spark, d, "lineitem").select((F.col("l_orderkey") + 7).alias("id"), (F.col("l_orderkey") % 5 == 0).alias("archived"))
    threads = _orders(spark, d).select("id", (F.col("status") == "F").alias("archived"))
    index = table(spark, d, "labels").select((F.col("doc_id") + 1).alias("id"))
    return L.state_counts(logs, index, threads, threads.where("id % 11 = 0").select("id"), threads.where("id % 13 = 0").select("id"))


def _history(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 9 != 0, F.col("user_id") * 3).alias("session"))
    return L.history_links(rows, table(spark, d, "conversations").select(F.col("conv_id").alias("session")))


def _family(spark, d):
    """Families of a customer's orders: the least one is active, each seventh id has gone."""
    o = _orders(spark, d)
    branches = o.select(F.col("cust").alias("family"), "id", (F.col("status") != "F").alias("live"), (F.col("id") % 7 > 1).alias("exists"))
    families = o.groupBy(F.col("cust").alias("family")).agg(F.min("id").alias("active")).select("family", "active", (F.col("family") % 5 != 0).alias("consistent"), (F.col("family") % 3 != 0).alias("repairable"))
    return families, branches


_FAMILY = """branches as (select o_custkey as family, o_orderkey as id, o_orderstatus <> 'F' as live, o_orderkey % 7 > 1 as ex from orders),
  families as (select family, min(id) as active, family % 5 <> 0 as consistent, family % 3 <> 0 as repairable from branches group by 1)"""


def _problems(spark, d):
    families, branches = _family(spark, d)
    chain = branches.where("id % 11 <> 0").select("family", "id").unionByName(branches.where("id % 50 = 0").select((F.col("family") + 1).alias("family"), "id"))
    return L.family_problems(families, chain, branches.where("id % 13 <> 0").select("id", "family"))


def _clone(spark, d):
    s = sessions(spark, d)
    state = L.clone_state(F.when(F.col("id") % 9 != 0, F.col("provider")), F.lit("BUILDING"), F.col("id") % 4 == 0, F.col("id") % 10 == 3, F.col("archived"), F.col("id") % 2 == 0, F.col("id") % 17 != 0)
    return s.select("id", state.alias("state"))


def _digests(spark, d):
    docs = table(spark, d, "documents")
    manifest = docs.select("source", F.col("doc_id").alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 10 == 2, F.concat(F.lit("\u0001"), F.substring("text", 2, 10_000_000))).otherwise(F.col("text"))
    objects = docs.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("name"), text.alias("data"))
    return L.verify_digests(manifest, objects, "source")


_DIGESTS = """m as (select source, doc_id as name, strlen(text) as size, sha256(text) as sha from documents),
  o as (select doc_id as name, case doc_id % 10 when 1 then text || 'x' when 2 then chr(1) || substr(text, 2) else text end as data from documents where doc_id % 8 <> 0),
  states as (select source, m.name, case when data is null then 'missing' when strlen(data) <> size then 'wrong size' when sha256(data) <> sha then 'wrong digest' else 'ok' end as state from m left join o on m.name = o.name)"""


def _newer(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.when(F.col("user_id") % 6 != 0, F.col("event_id")).alias("at"), "event_type")
    return L.keep_newer(e.where("event_type = 'click'"), e.where("event_type = 'view'"))


def _origins(spark, d):
    names = F.array(*[F.lit(x) for x in ("unknown", "retention", "cleanup", "migration", "import", "restored", "user")])
    return L.origin_of(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), names[F.floor(F.col("l_quantity") % 7).cast("int")].alias("origin")))


def _inbox(spark, d):
    e = table(spark, d, "events")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    return L.inbox(e.select(F.col("user_id").alias("key"), severity.alias("severity"), F.col("event_id").alias("at"), F.col("event_id").alias("id"))).select("key", "severity", "id")


def _winning(spark, d):
    return L.winning_values(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("stamp"), F.col("l_returnflag").alias("value")))


def _residue(spark, d):
    rows = table(spark, d, "events").select(F.concat_ws(":", "event_type", "user_id", "event_id").alias("key"), F.col("props").alias("value"))
    return L.residue(rows, table(spark, d, "conversations").select(F.col("conv_id").alias("session")))


def _cwd(spark, d):
    o = table(spark, d, "lineitem")
    return L.auto_cwd(o.select(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("cwd"), (F.col("l_linenumber") == 1).alias("exact"), (F.col("l_partkey") % 3 == 0).alias("available")))


def _mismatch(spark, d):
    s = sessions(spark, d)
    branches = s.where("id % 4 <> 0").select("id", F.col("cwd").alias("family"), (F.col("id") % 3 == 0).alias("active"))
    return L.provider_mismatch(s, "BUILDING", branches)


def _health(spark, d):
    p = table(spark, d, "lineitem")
    severity = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    return L.health_report(p.select(F.col("l_suppkey").alias("provider"), severity.alias("severity"), F.col("l_linestatus").alias("message")))


def _resume(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("cwd"), (F.col("o_custkey") % 10).alias("project"))
    return L.resume_places(table(spark, d, "nation").select((F.col("n_nationkey") % 10).cast("long").alias("project"), F.col("n_regionkey").cast("long").alias("path")), s)


def _visible(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), (F.col("conv_id") % 9 == 0).alias("sidechain"), F.when((F.col("turn") == 2) & (F.col("conv_id") % 2 == 0), F.col("text")).alias("title"), F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), F.col("text")).alias("prompt"))
    return L.title_visibility(rows)


QUERIES = {
    "id_set_diff": _diff,
    "state_counts": _counts,
    "history_links": _history,
    "clone_state": _clone,
    "digest_states": _digests,
    "digests_verified": lambda spark, d: L.verified(_digests(spark, d), "source"),
    "keep_newer": _newer,
    "archive_origin": _origins,
    "family_problems": _problems,
    "family_prune_plan": lambda spark, d: L.prune_plan(*_family(spark, d)),
    "recovery_inbox": _inbox,
    "overlay_winner": _winning,
    "kv_residue": _residue,
    "latency_percentiles": lambda spark, d: L.percentiles(table(spark, d, "events"), "value", "event_type"),
    "auto_cwd": _cwd,
    "provider_mismatch": _mismatch,
    "health_report": _health,
    "resume_places": _resume,
    "title_visibility": _visible,
}

_ID_SETS = {"threads": "select o_orderkey as id from orders", "index": "select doc_id + 1 as id from labels", "logs": "select l_orderkey + 7 as id from lineitem"}
_GRAVE = "case severity when 'error' then 0 when 'warning' then 1 else 2 end"

ORACLES = {
    "id_set_diff": " union all ".join(f"select 'in {a} not in {b}' as problem, id from ({_ID_SETS[a]} except {_ID_SETS[b]})" for a, b in [("threads", "logs"), ("index", "threads"), ("logs", "threads"), ("logs", "index")]),
    "state_counts": """with l as (select l_orderkey + 7 as id, l_orderkey % 5 = 0 as archived from lineitem), live as (select distinct id from l where not archived), a as (select distinct id from l),
      i as (select distinct doc_id + 1 as id from labels), t as (select o_orderkey as id, o_orderstatus = 'F' as archived from orders)
      select (select count(*) from live) as logs, (select count(*) from l where archived) as archived_logs, (select count(*) from i) as "index", (select count(*) from t) as threads,
        (select count(*) from t where not archived) as threads_active, (select count(*) from t where archived) as threads_archived,
        (select count(*) from (from live except from i)) as missing_in_index, (select count(*) from (from live except select id from t)) as missing_in_threads,
        (select count(*) from (from i except from live)) as orphan_in_index, (select count(*) from (select id from t except from a)) as orphan_in_threads,
        (select count(*) from t where id % 11 = 0) as orphan_subagents, (select count(*) from t where id % 13 = 0) as mismatched""",
    "history_links": """with h as (select case when event_id % 9 <> 0 then user_id * 3 end as s from events), k as (select distinct conv_id as s from conversations)
      select count(*) as total, count(k.s) as linked, count(*) filter (h.s is not null and k.s is null) as orphan, count(*) filter (h.s is null) as untracked, count(distinct case when k.s is null then h.s end) as orphan_ids from h left join k on h.s = k.s""",
    "clone_state": f"""with {SESSIONS} select id, case when archived then 'matches' when id % 10 = 3 then 'subagent' when id % 17 = 0 or id % 9 = 0 then 'unknown'
      when provider = 'BUILDING' then case when id % 2 = 0 then 'matches' else 'resync' end when id % 4 = 0 then 'has_clone' else 'clonable' end as state from sessions""",
    "digest_states": f"with {_DIGESTS} select * from states",
    "digests_verified": f"with {_DIGESTS} select source, count(*) as n, count(*) filter (state <> 'ok') as n_bad, bool_and(state = 'ok') as all_ok from states group by 1",
    "keep_newer": """with e as (select user_id as session, case when user_id % 6 <> 0 then event_id end as seen, event_type from events),
      b as (select session, max(seen) filter (event_type = 'click') as here, max(seen) filter (event_type = 'view') as there from e where event_type in ('click', 'view') group by 1 having count(distinct event_type) = 2),
      r as (select session, case when here is null then 'no local time' when there is null then 'no bundle time' when here >= there then 'local is newer or the same' end as reason from b) select session, reason is not null as keep_local, reason from r""",
    "archive_origin": "select l_orderkey as id, (['unknown', 'retention', 'cleanup', 'migration', 'import', 'restored', 'user'])[max(cast(floor(l_quantity % 7) as integer)) + 1] as origin from lineitem group by 1",
    "family_problems": f"""with {_FAMILY}, chain as (select family, id from branches where id % 11 <> 0 union select family + 1, id from branches where id % 50 = 0), idx as (select id, family from branches where id % 13 <> 0)
      select family, 'no branches' as problem from families where family not in (select family from chain)
      union all select family, 'active is no branch' from families f where not exists (select 1 from chain c where c.family = f.family and c.id = f.active)
      union all select distinct family, 'branch in several families' from chain where id in (select id from chain group by id having count(*) > 1)
      union all select distinct family, 'branch without index' from chain c where not exists (select 1 from idx i where i.family = c.family and i.id = c.id)
      union all select distinct family, 'index without branch' from idx i where not exists (select 1 from chain c where i.family = c.family and i.id = c.id)""",
    "family_prune_plan": f"""with {_FAMILY}, n as (select b.family, count(*) filter (ex) as l, count(*) filter (not ex) as lost, bool_or(ex and id = active) as has, count(*) filter (ex and live) as nl, min(id) filter (ex and live) as o from branches b join families f on b.family = f.family group by 1),
      a as (select f.*, o, case when l = 0 then case when consistent then 'drop' else 'skip' end when not has then case when nl = 1 and repairable then 'recover' else 'skip' end
        when not consistent then case when repairable then 'normalise' else 'skip' end when lost > 0 then 'prune' else 'keep' end as action from families f join n on f.family = n.family)
      select family, action, case when action = 'recover' then o else active end as active from a""",
    "recovery_inbox": f"""with e as (select user_id as key, case event_type when 'error' then 'error' when 'click' then 'warning' else 'info' end as severity, event_id as id from events)
      select key, severity, id from e qualify row_number() over (partition by key order by {_GRAVE}, id desc, id) = 1""",
    "overlay_winner": """with l as (select l_suppkey as key, max(l_shipdate) as stamp from lineitem group by 1)
      select key, min(l_returnflag) as value, count(distinct l_returnflag) > 1 as conflict from lineitem join l on l_suppkey = key and l_shipdate = stamp group by 1""",
    "kv_residue": "select event_type as kind, count(*) as rows, cast(sum(strlen(props)) as bigint) as bytes, count(distinct user_id) as sessions from events where user_id not in (select conv_id from conversations) group by 1",
    "latency_percentiles": "select event_type, count(value) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as max from events group by 1",
    "auto_cwd": """with c as (select l_orderkey as session, max(l_suppkey) filter (l_partkey % 3 = 0 and l_linenumber = 1) as e, count(distinct l_suppkey) filter (l_partkey % 3 = 0) as n, max(l_suppkey) filter (l_partkey % 3 = 0) as m from lineitem group by 1)
      select session, coalesce(e, case when n = 1 then m end) as cwd from c""",
    "provider_mismatch": f"""with {SESSIONS} select id, provider, case when id % 4 <> 0 then cwd end as family from sessions
      where provider <> 'BUILDING' and case when id % 4 <> 0 then id % 3 = 0 else not archived end""",
    "health_report": f"""with h as (select distinct l_suppkey as provider, case l_returnflag when 'R' then 'error' when 'A' then 'warning' else 'info' end as severity, l_linestatus as message from lineitem)
      select *, row_number() over (partition by provider order by {_GRAVE}, message) as place from h""",
    "resume_places": """with s as (select o_orderkey as session, case when o_orderkey % 5 <> 0 then o_custkey end as cwd, o_custkey % 10 as project from orders),
      c as (select session, cwd, 0 as rank from s union all select session, n_regionkey, 1 from s join nation on n_nationkey % 10 = project)
      select session, cast(cwd as bigint) as cwd, case when min(rank) = 0 then 'session' else 'project' end as origin from c where cwd is not null group by 1, 2""",
    "title_visibility": """with r as (select conv_id as path, turn, count(*) over (partition by conv_id) as n, case when turn = 2 and conv_id % 2 = 0 then trim(text) end as title, case when role = 'user' and conv_id % 3 = 0 then trim(text) end as prompt, row_number() over (partition by conv_id order by turn desc) as back from conversations)
      select path, case when path % 9 = 0 then 'sidechain' when count(*) filter (title <> '' and (turn < 50 or back <= 50)) > 0 then 'visible' when count(*) filter (title <> '' or prompt <> '') > 0 then 'fixable' else 'unfixable' end as state from r group by 1""",
}

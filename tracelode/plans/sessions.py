"""Queries of session lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import sessions as L
from ..session import table
from .tables import SESSIONS, sessions

TODAY = 992_304_000
_S = f"with {SESSIONS}"
_FAMILY = """f as (select *, case when cast(cwd as bigint) % 3 <> 0 then 'fam' || cwd end as family, id % 4 = 0 as active from sessions)"""
_ORIGINS = ("user", "restored", "import", "migration", "retention", "cleanup")


def _family(s):
    return s.withColumn("family", F.when(F.col("cwd").cast("long") % 3 != 0, F.concat(F.lit("fam"), "cwd"))).withColumn("active", F.col("id") % 4 == 0)


def _ledger(s):
    names = F.array(*[F.lit(x) for x in _ORIGINS])
    return s.where(F.col("id") % 5 != 0).select("id", names[(F.col("id") % 6).cast("int")].alias("origin"))


_LEDGER = "ledger as (select id, ([" + ", ".join(f"'{o}'" for o in _ORIGINS) + "])[id % 6 + 1] as origin from sessions where id % 5 <> 0)"


def _source(s):
    i = F.col("id") % 7
    return s.select("id", "archived", F.when(i == 0, "subagent").when(i == 1, F.concat(F.lit("parent:"), "id")).when(i == 2, F.lit('{"subagent":{"x":1}}')).when(i == 3, "cli").alias("source"), F.when(i == 4, F.lit(" ")).when(i == 5, "bob").alias("nick"), F.lit(None).cast("string").alias("role"))


_SOURCE = """src as (select id, archived, case id % 7 when 0 then 'subagent' when 1 then 'parent:' || id when 2 then '{"subagent":{"x":1}}' when 3 then 'cli' end as source, case id % 7 when 4 then ' ' when 5 then 'bob' end as nick from sessions),
  sub as (select *, coalesce(source = 'subagent' or source like 'parent:_%' or source like '{"subagent":%', false) or coalesce(trim(nick) <> '', false) as is_sub from src)"""


def _scope(which):
    def run(spark, d):
        s = _source(sessions(spark, d))
        return L.scope(s, which, L.is_subagent(F.col("source"), F.col("nick"), F.col("role"))).select("id")

    return run


def _meta(query):
    return lambda spark, d: sessions(spark, d).where(L.metadata_query(query, ("title", "cwd"))).select("id")


def _archive(spark, d):
    s = sessions(spark, d)
    return L.by_origin(s, _ledger(s)).select("id", "origin")


def _events(spark, d):
    names = F.array(*[F.lit(x) for x in ("unknown", *_ORIGINS)])
    return table(spark, d, "events").select(F.col("user_id").alias("id"), names[(F.col("event_id") % 7).cast("int")].alias("origin")).where((F.col("id") % 4 != 0) | (F.col("origin") == "unknown"))


_PAGE = "select id, place from (select id, row_number() over (order by updated_at desc, created_at desc, id) as place from sessions) where place between 41 and 60"
_URL = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def _urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))


def _projects(spark, d):
    """Hosts, and hosts with a language folder where they have one of even number."""
    path = _urls(spark, d)
    host = F.substring_index("path", "/", 1)
    return path.select(host.alias("p")).union(path.where(F.col("page_id") % 2 == 0).select(F.substring_index("path", "/", 2).alias("p"))).distinct()


def _live(spark, d):
    s = sessions(spark, d)
    live = s.where(F.col("id") % 3 == 0).select("id", F.lit("live").alias("origin"))
    return L.live_and_indexed(live, s.where(F.col("id") % 2 == 0).select("id", F.lit("indexed").alias("origin")), ["id"])


def _titles(spark, d):
    s = sessions(spark, d)
    i = F.col("id") % 5
    pick = lambda n, c: F.when(i == n, c)
    return s.select("id", L.title(pick(1, F.concat(F.lit("index "), "id")), pick(2, F.concat(F.lit("name "), "id")), F.col("title"), F.when(i == 3, F.col("title")).otherwise(F.lit(None).cast("string"))).alias("title"))


QUERIES = {
    "workbench_filter": lambda spark, d: L.workbench(sessions(spark, d), provider="BUILDING", archived=False, text="0001").select("id", "cwd", "title"),
    "metadata_search": _meta("customer#00000001"),
    "metadata_search_id": _meta("ID: 12"),
    "metadata_search_model": _meta("model: URGENT"),
    "metadata_search_archived": _meta("archived: yes"),
    "scope_main": _scope("main"),
    "scope_subagent": _scope("subagent"),
    "archive_origin_filter": _archive,
    "archive_origin_winner": lambda spark, d: L.winning_origin(_events(spark, d)),
    "bundle_range": lambda spark, d: L.updated_in(sessions(spark, d), 820_454_400, 852_076_800).select("id", "updated_at"),
    "family_active": lambda spark, d: L.family_active(sessions(spark, d), _family(sessions(spark, d)).where("family is not null").groupBy("family").agg(F.min("id").alias("active_id")).join(_family(sessions(spark, d)).select("id", "family"), "family")).select("id", "family"),
    "family_dangling": lambda spark, d: L.dangling_families(sessions(spark, d), _family(sessions(spark, d)).select("id", "family"), _family(sessions(spark, d)).where("id % 7 = 0").select("family").distinct(), "BUILDING"),
    "family_representative": lambda spark, d: L.representatives(_family(sessions(spark, d)), "BUILDING").select("id", "family"),
    "list_by_activity": lambda spark, d: L.page(sessions(spark, d), L.by_activity(None), 40, 20).select("id", F.col("place").cast("long").alias("place")),
    "list_by_size": lambda spark, d: sessions(spark, d).orderBy(*L.by_size(bytes_="logs_count")).limit(50).select("id", "tokens_used", "logs_count"),
    "recency_buckets": lambda spark, d: sessions(spark, d).groupBy(L.recency(F.col("updated_at"), TODAY).alias("bucket")).agg(F.count("*").alias("sessions")),
    "select_title": _titles,
    "overlay_ledger": lambda spark, d: L.overlay_with_ledger(sessions(spark, d).select("id", F.lit("overlay").alias("origin")), _ledger(sessions(spark, d))),
    "live_and_indexed": _live,
    "unresolved_paths": lambda spark, d: L.unresolved(spark.range(0, 3000, 7).select(F.col("id").cast("string").alias("cwd")), sessions(spark, d), ["cwd"]),
    "scope_paths_semi": lambda spark, d: sessions(spark, d).join(spark.range(0, 3000, 7).select(F.col("id").cast("string").alias("cwd")), "cwd", "left_semi").select("id", "cwd"),
    "newest_positions": lambda spark, d: L.newest_places(table(spark, d, "events"), ["user_id"], "ts", 20).select("user_id", "event_id"),
    "longest_prefix_match": lambda spark, d: L.longest_prefix(_urls(spark, d), "path", _projects(spark, d), "p"),
    "human_numbers": lambda spark, d: sessions(spark, d).select("id", X.human_bytes(F.col("tokens_used") * F.col("id")).alias("bytes"), X.human_tokens(F.col("tokens_used") * 1000).alias("tokens")),
    "provider_union": lambda spark, d: sessions(spark, d).select("id", "provider").unionByName(table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type").withColumnRenamed("event_type", "provider"), allowMissingColumns=True).groupBy("provider").agg(F.count("*").alias("n")),
}

_HB = "tokens_used * id"
_STEP = lambda k, unit: f"when {_HB} >= {1024**k} then case when {_HB} / {1024.0**k} >= 100 then printf('%.0f', floor({_HB} / {1024.0**k} + 0.5)) else printf('%.1f', floor({_HB} / {1024.0**k} * 10 + 0.5) / 10) end || ' {unit}'"

ORACLES = {
    "workbench_filter": f"{_S} select id, cwd, title from sessions where provider = 'BUILDING' and not archived and (contains(lower(title), '0001') or contains(cwd, '0001') or contains(cast(id as varchar), '0001') or contains(lower(model), '0001'))",
    "metadata_search": f"{_S} select id from sessions where contains(lower(title), 'customer#00000001') or contains(cwd, 'customer#00000001')",
    "metadata_search_id": f"{_S} select id from sessions where cast(id as varchar) like '12%'",
    "metadata_search_model": f"{_S} select id from sessions where contains(lower(model), 'urgent')",
    "metadata_search_archived": f"{_S} select id from sessions where archived",
    "scope_main": f"{_S}, {_SOURCE} select id from sub where not is_sub and not archived",
    "scope_subagent": f"{_S}, {_SOURCE} select id from sub where is_sub",
    "archive_origin_filter": f"{_S}, {_LEDGER} select id, coalesce(origin, 'unknown') as origin from sessions left join ledger using (id) where archived and coalesce(origin, 'unknown') in ('user', 'restored', 'unknown')",
    "archive_origin_winner": "with e as (select user_id as id, (['unknown', 'user', 'restored', 'import', 'migration', 'retention', 'cleanup'])[event_id % 7 + 1] as origin from events) select id, arg_max(origin, list_position(['unknown', 'retention', 'cleanup', 'migration', 'import', 'restored', 'user'], origin)) as origin from e where id % 4 <> 0 or origin = 'unknown' group by 1",
    "bundle_range": f"{_S} select id, updated_at from sessions where updated_at >= 820454400 and updated_at < 852076800",
    "family_dangling": f"{_S}, {_FAMILY} select id, family from f where provider = 'BUILDING' and family is not null and family not in (select family from f where id % 7 = 0 and family is not null)",
    "family_active": f"{_S}, {_FAMILY}, a as (select family, min(id) as active_id from f where family is not null group by 1) select f.id, f.family from f left join a using (family) where f.family is null or f.id = active_id",
    "family_representative": f"{_S}, {_FAMILY} select id, family from f qualify family is null or row_number() over (partition by family order by case when provider = 'BUILDING' then 2 when active then 1 else 0 end desc, updated_at desc, active desc, created_at desc, id) = 1",
    "list_by_activity": f"{_S} {_PAGE}",
    "list_by_size": f"{_S} select id, tokens_used, logs_count from sessions order by tokens_used desc, logs_count desc, updated_at desc, id limit 50",
    "recency_buckets": f"{_S} select case when updated_at >= {TODAY} then 'today' when updated_at >= {TODAY} - 86400 then 'yesterday' when updated_at >= {TODAY} - 6 * 86400 then 'week' when updated_at >= {TODAY} - 29 * 86400 then 'month' else 'earlier' end as bucket, count(*) as sessions from sessions group by 1",
    "select_title": f"{_S} select id, case id % 5 when 1 then 'index ' || id when 2 then 'name ' || id else title end as title from sessions",
    "overlay_ledger": f"{_S}, {_LEDGER} select id, coalesce(ledger.origin, 'overlay') as origin from sessions left join ledger using (id)",
    "live_and_indexed": f"{_S} select id, case when id % 3 = 0 then 'live' else 'indexed' end as origin from sessions where id % 3 = 0 or id % 2 = 0",
    "unresolved_paths": f"{_S} select cast(i as varchar) as cwd from range(0, 3000, 7) t(i) where cast(i as varchar) not in (select cwd from sessions)",
    "scope_paths_semi": f"{_S} select id, cwd from sessions where cwd in (select cast(i as varchar) from range(0, 3000, 7) t(i))",
    "newest_positions": "select user_id, event_id from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) order by ts desc, user_id limit 20",
    "longest_prefix_match": f"""with u as (select page_id, {_URL} as path from pages), p as (select split_part(path, '/', 1) as p from u union select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) from u where page_id % 2 = 0)
      select page_id, path, (select arg_max(p, length(p)) from p where path = p or starts_with(path, p || '/')) as project from u""",
    "human_numbers": f"{_S} select id, case when {_HB} <= 0 then '0 B' {_STEP(4, 'TB')} {_STEP(3, 'GB')} {_STEP(2, 'MB')} {_STEP(1, 'KB')} else ({_HB}) || ' B' end as bytes, case when tokens_used >= 1000000 then printf('%.1f', tokens_used / 1000000.0) || 'B' when tokens_used >= 1000 then printf('%.1f', tokens_used / 1000.0) || 'M' when tokens_used >= 1 then printf('%.1f', tokens_used / 1.0) || 'K' else '0' end as tokens from sessions",
    "provider_union": f"{_S} select provider, count(*) as n from (select provider from sessions union all select event_type from events) group by 1",
}

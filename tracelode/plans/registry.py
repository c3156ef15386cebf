"""Queries of the registry's joins, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as L, search as S
from ..session import table
from .searches import documents_index


def _metadata(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pk"), F.col("o_orderstatus").alias("source"), F.to_json(F.struct(F.col("o_custkey").alias("owner"))).alias("metadata"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("file"), F.concat(F.lit("/l/"), "l_suppkey").alias("path"), F.col("l_partkey").alias("seen_at"))
    return L.cached_metadata(o, files, "F").select("pk", "file", "path", F.variant_get("metadata", "$.owner", "bigint").alias("owner"), "seen_at")


def _sessions(spark, d):
    """Every document is a session; some have no title, a project that isn't listed, or no time of change."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("pk"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("title"), F.col("source").alias("provider"), (F.col("doc_id") % 30).alias("project_id"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100).alias("updated_at"), F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 90).alias("created_at"),
    )


def _documents(spark, d):
    texts = table(spark, d, "documents").select((F.col("doc_id") + 2).alias("pk"), F.col("text").alias("content"), F.array("lang", "source").alias("tool_names"), F.array(F.lit("/a"), "source").alias("paths"))
    projects = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return _sessions(spark, d), projects, texts


def _hits(spark, d):
    index = documents_index(spark, d)
    found = [index.registry("the ent", ("text",), ("text",)), index.literal("inthe", "text")]
    found = [x.select(F.col("idx").alias("pk")) for x in found]
    return L.search_hits(found, _sessions(spark, d), L.search_documents(*_documents(spark, d)))


def _outside(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws(":", "event_type", "event_id").alias("key"))
    return rows.where(L.outside_prefix(F.col("key"), "error:"))


QUERIES = {
    "registry_metadata": _metadata,
    "search_documents": lambda spark, d: L.search_documents(*_documents(spark, d)),
    "unknown_texts": lambda spark, d: (lambda s, _, t: L.unknown_texts(s, t))(*_documents(spark, d)).select("pk"),
    "registry_hits": _hits,
    "keys_outside_prefix": _outside,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOCS = """t as (select doc_id + 2 as pk, text as content, concat_ws(chr(10), lang, source) as tool_names, concat_ws(chr(10), '/a', source) as paths from documents),
  s as (select doc_id as pk, case when doc_id % 4 <> 0 then lang end as title, source as provider, doc_id % 30 as project_id, coalesce(case when doc_id % 3 <> 0 then doc_id % 100 end, case when doc_id % 6 <> 0 then doc_id % 90 end, 0) as changed from documents),
  d as (select pk, coalesce(title, '') as title, coalesce(n_name, '') as project, provider, content, tool_names, paths from t join s using (pk) left join nation on n_nationkey = project_id)"""
_WORDS = "' ' || regexp_replace(translate(lower(text), '" + S.MARKED + "', '" + S.PLAIN + "'), '[^\\p{L}\\p{N}]+', ' ', 'g')"

ORACLES = {
    "registry_metadata": "select o_orderkey as pk, l_linenumber as file, '/l/' || l_suppkey as path, o_custkey as owner, l_partkey as seen_at from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F'",
    "search_documents": f"with {_DOCS} select * from d",
    "unknown_texts": "select doc_id + 2 as pk from documents where doc_id + 2 not in (select doc_id from documents)",
    "registry_hits": f"""with {_DOCS}, m as (select doc_id as pk from documents where contains(lower(text), 'the ent') or contains({_WORDS}, ' the ent') or contains(translate(text, '{_UP}', '{_LOW}'), 'inthe'))
      select pk, s.title, nullif(d.project, '') as project, s.provider from m join s using (pk) join d using (pk) order by changed desc, pk limit 50""",
    "keys_outside_prefix": "select event_id, event_type || ':' || event_id as key from events where not starts_with(event_type || ':' || event_id, 'error:')",
}

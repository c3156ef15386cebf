"""Queries of content-addressed stores, written from documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import blobs as L
from ..session import table
from ..sources.agents import child_blobs
from .tables import TRANSCRIPT, transcript


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def _store(spark, d, damaged: bool = False):
    """A blob a document, which names two others amid its text; states and pointers name some, every other row names contents.

    A damaged store also has pointers that are too short, states in no alphabet and blobs without a value.
    """
    t = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i, utf8 = F.col("doc_id"), F.encode("text", "UTF-8")
    raw = lambda n: F.unhex(_digest("b", n.cast("string")))
    blob = F.concat(utf8, raw(i * 2 + 5), F.substring(utf8, 1, 3), raw(i * 3 + 1), utf8)
    if damaged:
        blob = F.when(i % 40 != 17, blob)
    state = F.concat(F.lit('{"conversationState": "~'), F.base64(F.concat(F.substring(utf8, 1, 5), raw(i))), F.lit('", "n": 1}'))
    if damaged:
        state = F.when(i % 100 == 7, F.lit('{"conversationState": "*"}')).otherwise(state)
    pointer = F.base64(raw(i)) if not damaged else F.base64(F.substring(raw(i), 1, 31))
    bytes_ = lambda c: F.encode(c, "UTF-8")
    n = i.cast("string")
    rows = [
        F.struct(F.concat(F.lit(L.BLOB), _digest("b", n)).alias("key"), blob.alias("value")),
        F.when(i % 50 == 7, F.struct(F.concat(F.lit("bubbleId:c:"), n).alias("key"), bytes_(state).alias("value"))),
        F.when(i % 90 == 9, F.struct(F.concat(F.lit("agentKv:checkpoint:"), n).alias("key"), bytes_(pointer).alias("value"))),
        F.when(i % 3 == 0, F.struct(F.concat(F.lit(L.CONTENT), _digest("c", n)).alias("key"), utf8.alias("value"))),
        F.when(i % 4 == 0, F.struct(F.concat(F.lit("other:"), n).alias("key"), F.concat(utf8, bytes_(F.concat(F.lit(L.CONTENT), F.upper(_digest("c", n)))), utf8).alias("value"))),
    ]
    return t.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


_GRAPH = """d as (select doc_id as i, strlen(coalesce(text, '')) as n from documents where doc_id is not null),
  e as (select i as a, i * 2 + 5 as b from d union select i, i * 3 + 1 from d),
  u(i) as (select i from d where {roots} union select b from u join e on u.i = e.a join d on d.i = e.b where {passes})"""


def _swept(roots: str, passes: str, size: str, veto: bool) -> str:
    deletable = "false" if veto else "not live"
    return f"""with recursive {_GRAPH.format(roots=roots, passes=passes)},
      r as (select 'agentKv:blob:' || sha256('b' || i) as key, 'blob' as kind, {size} as bytes, i in (select i from u) as live from d
        union all select 'composer.content.' || sha256('c' || i), 'content', n, i % 4 = 0 from d where i % 3 = 0)
      select key, kind, bytes, live, {deletable} as deletable from r"""


def _chats(spark, d):
    """A conversation as blobs: words of a system as they are, of users in tags after context, of helpers around a call and a result."""
    t = transcript(spark, d).withColumn("id", _digest(F.col("session").cast("string"), ":", F.col("idx").cast("string")))
    block = lambda kind, **kw: F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in kw.items()]))
    n, half = F.col("idx"), F.substring("text", 1, 10)
    call = F.concat(F.lit("c"), n)
    user = [block("text", text=F.lit(" <user_info>os</user_info>")), block("text", text=F.concat(F.lit("<user_query>\n"), "text", F.lit("\n</user_query>")))]
    helper = [block("text", text=half), block("thought", text=F.lit("hm")), block("text", text=F.col("text")), block("tool-call", toolCallId=call, toolName=F.lit("run")), block("tool-result", toolCallId=call, result=F.struct(n.alias("n"))), block("text", text=F.lit("done"))]
    content = F.when(F.col("role") == "user", F.concat(F.lit("["), F.concat_ws(",", *user), F.lit("]"))).when(F.col("role") == "assistant", F.concat(F.lit("["), F.concat_ws(",", *helper), F.lit("]")))
    plain = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)\A\{"text":(.*)\}\z', 1)
    body = F.concat(F.lit('{"role":"'), "role", F.lit('","content":'), F.when(F.col("role").isin("user", "assistant"), content).otherwise(plain), F.lit("}"))
    messages = t.select("session", "id", F.encode(body, "UTF-8").alias("data"))
    ids = F.array_sort(F.collect_list(F.struct("idx", "id")))
    field = F.concat(F.lit("1005"), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("0a20"), x["id"])), ""), F.lit("0a20"), F.repeat(F.lit("ab"), 32), F.lit("0a03616263"))
    roots = t.groupBy("session").agg(F.unhex(field).alias("data")).withColumn("id", _digest("root", F.col("session").cast("string")))
    return L.chat_events(messages.unionByName(roots.select("session", "id", "data")), roots.select("session", F.col("id").alias("root")), child_blobs("data"))


QUERIES = {
    "blob_sweep": lambda spark, d: L.sweep(_store(spark, d)),
    "blob_sweep_vetoed": lambda spark, d: L.sweep(_store(spark, d, damaged=True)),
    "blob_problems": lambda spark, d: L.unreadable(_store(spark, d, damaged=True), L.live(_store(spark, d, damaged=True))),
    "agent_chats": _chats,
}

_SIZE = "2 * n + 64 + least(n, 3)"
_DAMAGED = ("i % 50 = 7 and i % 100 <> 7", "u.i % 40 <> 17")
ORACLES = {
    "blob_sweep": _swept("i % 50 = 7 or i % 90 = 9", "true", _SIZE, False),
    "blob_sweep_vetoed": _swept(*_DAMAGED, f"case when i % 40 = 17 then 0 else {_SIZE} end", True),
    "blob_problems": f"""with recursive {_GRAPH.format(roots=_DAMAGED[0], passes=_DAMAGED[1])}
      select 'bubbleId:c:' || i as key, 'reference' as problem from d where i % 100 = 7 union all select 'agentKv:checkpoint:' || i, 'reference' from d where i % 90 = 9
      union all select 'agentKv:blob:' || sha256('b' || i), 'value' from u where i % 40 = 17""",
    "agent_chats": f"""with {TRANSCRIPT}, e as (
        select session, idx, 0 as part, 'meta' as role, text, null as call from transcript where role = 'system'
        union all select session, idx, 0, 'meta', '', null from transcript where role = 'user' union all select session, idx, 1, 'user', trim(text, ' ' || chr(9) || chr(10) || chr(13)), null from transcript where role = 'user'
        union all select session, idx, unnest([0, 1, 2, 3]), unnest(['assistant', 'tool_call', 'tool_result', 'assistant']), unnest([substr(text, 1, 10) || chr(10) || chr(10) || text, 'run', '{{"n":' || idx || '}}', 'done']), unnest([null, 'c' || idx, 'c' || idx, null]) from transcript where role = 'assistant')
      select session, cast((select count(*) from transcript t where t.session = e.session and t.idx < e.idx) as integer) as message, cast(part as integer) as part, role, text, call, sha256(session || ':' || idx) as blob from e""",
}

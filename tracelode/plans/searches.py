"""Queries of text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as L
from ..operators.index import Index, stamp
from ..session import shared_folder, table
from .tables import SESSIONS, TRANSCRIPT, sessions, transcript

Q = "the Ent"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AT = f"instr(translate(text, '{_UP}', '{_LOW}'), 'the ent')"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("idx"), "text", "lang")


def _snip(at: str, q: str) -> str:
    n = len(q)
    body = f"trim(regexp_replace(substr(text, greatest({at} - 72, 1), least({at} - 1, 72)) || substr(text, {at}, {n + 160}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
    return f"case when {at} > 0 then case when least({at} - 1, 72) = 72 then '...' else '' end || {body} || case when length(text) - {at} + 1 > {n + 160} then '...' else '' end else '' end"


def documents_index(spark, d) -> Index:
    """The index of the documents, written where it isn't yet or where their files have changed."""
    docs = _docs(spark, d)
    index = Index(spark, f"{shared_folder(spark)}/search-{stamp(docs)}", "idx", ("session", "lang", "text"))
    return index if index.complete() else index.build(docs)


def _registry(query):
    return lambda spark, d: documents_index(spark, d).registry(query, ("session", "lang", "text"), ("session", "lang")).select("idx")


_TOP = f"select source as session, doc_id as idx, row_number() over (partition by source order by doc_id) as nth, text from documents where {_AT} > 0"

QUERIES = {
    "literal_find": lambda spark, d: _docs(spark, d).select("idx", L.find(F.col("text"), Q).cast("long").alias("place"), L.byte_offset(F.col("text"), L.find(F.col("text"), Q)).cast("long").alias("offset")),
    "literal_find_exact": lambda spark, d: _docs(spark, d).select("idx", L.find(F.col("text"), "é de").cast("long").alias("place")),
    "snippet": lambda spark, d: _docs(spark, d).select("idx", L.snippet(F.col("text"), Q).alias("snippet")),
    "content_search": lambda spark, d: L.content_search(_docs(spark, d), Q).select("session", "idx", "snippet"),
    "search_extent": lambda spark, d: L.search_extent(transcript(spark, d).withColumnRenamed("role", "kind"), Q, 20),
    "top3_matches": lambda spark, d: L.content_search(_docs(spark, d), Q, 3, 5).select("session", "idx", F.col("nth").cast("long").alias("nth")),
    "registry_search_short": _registry("ß"),
    "registry_search_long": _registry("the ent"),
    "registry_search_marks": _registry("ent ete"),
    "registry_search_literal": _registry("the, a"),
    "search_newest": lambda spark, d: L.newest_hits(sessions(spark, d).where(F.contains("title", F.lit("00001"))), 25).select("id"),
    "gram_counts": lambda spark, d: documents_index(spark, d).gram_counts(),
    "trigram_search": lambda spark, d: documents_index(spark, d).literal("inthe", "text").select("idx"),
    "match_occurrences": lambda spark, d: _docs(spark, d).select("idx", L.occurrences(F.col("text"), "thth").alias("n")),
    "session_text_filter": lambda spark, d: L.session_filter(transcript(spark, d), "der", "role", "text").select("session", "idx"),
    "nearest_hits": lambda spark, d: L.next_hits(transcript(spark, d), F.contains(F.lower("text"), F.lit("que"))).select("session", "idx", "next_hit", "previous_hit"),
    "match_ranges": lambda spark, d: transcript(spark, d).select("session", "idx", F.explode(L.match_ranges(F.col("text"), "En")).alias("r")).select("session", "idx", F.col("r.start").cast("long").alias("start"), F.col("r.length").cast("long").alias("length")),
    "eligible_indices": lambda spark, d: L.eligible_indices(transcript(spark, d).withColumnRenamed("role", "kind"), ["user", "assistant"]).select("session", "idx", F.col("nth").cast("long").alias("nth")),
    "highlight_parts": lambda spark, d: transcript(spark, d).withColumn("hits", L.match_ranges(F.col("text"), "En")).select("session", "idx", F.posexplode(L.highlighted(F.col("text"), "En", F.col("hits"))).alias("place", "p")).select("session", "idx", F.col("place").cast("long").alias("place"), "p.part", "p.hit"),
}

_WORDS = "' ' || regexp_replace(translate(lower({c}), '" + L.MARKED + "', '" + L.PLAIN + "'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"


def _reg(test: str) -> str:
    return "select doc_id as idx from documents where " + " or ".join(test.format(c=c) for c in ("source", "lang", "text"))


QUERIES |= {
    # Capitals with marks, blanks around the query, and letters that are longer in lower case.
    "match_ranges_any_case": lambda spark, d: _cased(spark, d).select("session", "idx", F.explode(L.match_ranges(F.col("text"), " ÉT ")).alias("r")).select("session", "idx", F.col("r.start").cast("long").alias("start"), F.col("r.length").cast("long").alias("length")),
    "highlight_parts_any_case": lambda spark, d: _cased(spark, d).withColumn("hits", L.match_ranges(F.col("text"), "éT")).select("session", "idx", F.posexplode(L.highlighted(F.col("text"), "éT", F.col("hits"))).alias("place", "p")).select("session", "idx", F.col("place").cast("long").alias("place"), "p.part", "p.hit"),
}


def _cased(spark, d):
    text = F.concat(F.when(F.col("idx") % 2 == 0, F.lit("Été ÉTÉ ")).otherwise("İé "), F.when(F.col("idx") % 3 == 0, F.translate("text", "etéd", "ETÉD")).otherwise(F.col("text")))
    return transcript(spark, d).select("session", "idx", text.alias("text"))


#: Hits of a text in lower case, with the one letter that is longer there, İ, taken as one.
_HITS = f"""{TRANSCRIPT}, v as (select session, idx, case when idx % 2 = 0 then 'Été ÉTÉ ' else 'İé ' end || case when idx % 3 = 0 then translate(text, 'etéd', 'ETÉD') else text end as text, idx % 2 as more from transcript),
      l as (select *, string_split(replace(lower(text), 'i̇', 'i'), 'ét') as gaps from v),
      g as (select session, idx, text, unnest(gaps) as gap, generate_subscripts(gaps, 1) as n, len(gaps) as parts from l),
      p as (select *, cast(sum(length(gap)) over (partition by session, idx order by n) - length(gap) + 2 * (n - 1) as bigint) as here from g)"""

ORACLES = {
    "search_extent": f"with {TRANSCRIPT}, n as (select count(distinct session) as found from transcript where {_AT} > 0) select found, least(found, 20) as shown, found > 20 as truncated from n",
    "match_ranges_any_case": f"with {_HITS} select session, idx, here + length(gap) as start, 2::bigint as length from p where n < parts",
    "highlight_parts_any_case": f"""with {_HITS}, u as (select session, idx, n * 2 as o, substr(text, here + 1, length(gap)) as part, false as hit from p where length(gap) > 0 or parts = 1
        union all select session, idx, n * 2 + 1, substr(text, here + length(gap) + 1, 2), true from p where n < parts)
      select session, idx, row_number() over (partition by session, idx order by o) - 1 as place, part, hit from u""",
    "literal_find": f"select doc_id as idx, {_AT} as place, case when {_AT} > 0 then strlen(substr(text, 1, {_AT} - 1)) end as \"offset\" from documents",
    "literal_find_exact": "select doc_id as idx, instr(text, 'é de') as place from documents",
    "snippet": f"select doc_id as idx, {_snip(_AT, Q)} as snippet from documents",
    "content_search": f"with t as ({_TOP}), k as (select distinct session from t order by 1 limit 100) select session, idx, {_snip(_AT, Q)} as snippet from t where nth <= 3 and session in (select session from k)",
    "top3_matches": f"with t as ({_TOP}), k as (select distinct session from t order by 1 limit 5) select session, idx, nth from t where nth <= 3 and session in (select session from k)",
    "registry_search_short": _reg("contains(lower({c}), 'ß')"),
    "registry_search_long": _reg("contains(lower({c}), 'the ent') or contains(" + _WORDS + ", ' the ent')"),
    "registry_search_marks": _reg("contains(lower({c}), 'ent ete') or contains(" + _WORDS + ", ' ent ete')"),
    "registry_search_literal": _reg("contains(lower({c}), 'the, a')"),
    "search_newest": f"with {SESSIONS} select id from sessions where contains(title, '00001') order by updated_at desc, id limit 25",
    "gram_counts": """with t as (select doc_id, replace(lower(unnest([source, lang, text])), 'ς', 'σ') as t from documents),
      g as (select distinct doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as gram from t) select gram, count(*) as n from g group by gram""",
    "trigram_search": f"select doc_id as idx from documents where contains(translate(text, '{_UP}', '{_LOW}'), 'inthe')",
    "match_occurrences": f"select doc_id as idx, (length(text) - length(replace(translate(text, '{_UP}', '{_LOW}'), 'thth', ''))) // 4 as n from documents",
    "session_text_filter": f"with {TRANSCRIPT} select session, idx from transcript where contains(lower(role || chr(10) || text), 'der')",
    "nearest_hits": f"""with {TRANSCRIPT}, h as (select session, idx, case when contains(lower(text), 'que') then idx end as hit from transcript)
      select session, idx, coalesce(min(hit) over (partition by session order by idx rows between 1 following and unbounded following), min(hit) over (partition by session)) as next_hit,
        coalesce(max(hit) over (partition by session order by idx rows between unbounded preceding and 1 preceding), max(hit) over (partition by session)) as previous_hit from h""",
    "match_ranges": f"""with {TRANSCRIPT}, s as (select session, idx, unnest(string_split(translate(text, '{_UP}', '{_LOW}'), 'en')) as part, generate_subscripts(string_split(translate(text, '{_UP}', '{_LOW}'), 'en'), 1) as n from transcript),
      r as (select session, idx, n, max(n) over (partition by session, idx) as parts, sum(length(part)) over (partition by session, idx order by n) + 2 * (n - 1) as start from s)
      select session, idx, cast(start as bigint) as start, 2::bigint as length from r where n < parts""",
    "eligible_indices": f"with {TRANSCRIPT} select session, idx, row_number() over (partition by session order by idx) - 1 as nth from transcript where role in ('user', 'assistant') and trim(text) <> ''",
    "highlight_parts": f"""with {TRANSCRIPT}, c as (select session, idx, text, string_split(translate(text, '{_UP}', '{_LOW}'), 'en') as gaps from transcript),
      g as (select session, idx, text, unnest(gaps) as gap, generate_subscripts(gaps, 1) as n, len(gaps) as parts from c),
      p as (select *, cast(sum(length(gap)) over (partition by session, idx order by n) - length(gap) + 2 * (n - 1) as bigint) as here from g),
      u as (select session, idx, n * 2 as o, substr(text, here + 1, length(gap)) as part, false as hit from p where length(gap) > 0 or parts = 1
        union all select session, idx, n * 2 + 1, substr(text, here + length(gap) + 1, 2), true from p where n < parts)
      select session, idx, row_number() over (partition by session, idx order by o) - 1 as place, part, hit from u""",
}

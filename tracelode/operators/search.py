"""Literal text search: places, snippets, top matches, registry search, trigram postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import ascii_lower, squeezed

BEFORE, AFTER = 72, 160
PER_SESSION, SESSIONS = 3, 100
# Letters with marks and what they are without.
MARKED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüý", "aaaaaaceeeeiiiinooooouuuuy"


def checked(query: str) -> str:
    """A query of 2 to 256 characters without control characters."""
    query = query.strip()
    if not 2 <= len(query) <= 256 or any(ord(c) < 32 or ord(c) == 127 for c in query):
        raise ValueError("a query has 2 to 256 characters and no control characters")
    return query


def find(text: Column, query: str) -> Column:
    """Place of the first hit, from 1, or 0; an ASCII query ignores the case of A-Z, any other is exact."""
    if query.isascii():
        return F.instr(ascii_lower(text), query.lower())
    return F.instr(text, query)


def byte_offset(text: Column, place: Column) -> Column:
    return F.when(place > 0, F.octet_length(F.substr(text, F.lit(1), place - 1)))


def snippet(text: Column, query: str) -> Column:
    """The first hit with 72 characters before and 160 after it, white space squeezed; dots where text is left out."""
    at, n = find(text, query), len(query)
    before = F.substr(text, F.greatest(at - BEFORE, F.lit(1)), F.least(at - 1, F.lit(BEFORE)))
    after = F.substr(text, at, F.lit(n + AFTER))
    body = squeezed(F.concat(before, after))
    return F.when(at > 0, F.concat(F.when(F.length(before) == BEFORE, "...").otherwise(""), body, F.when(F.length(text) - at + 1 > n + AFTER, "...").otherwise(""))).otherwise("")


def content_search(rows: DataFrame, query: str, per_session: int = PER_SESSION, sessions: int = SESSIONS) -> DataFrame:
    """The first matches of each session by place, and the first sessions by name; rows have session, idx, text."""
    query = checked(query)
    hits = rows.where(find(F.col("text"), query) > 0)
    top = hits.withColumn("nth", F.row_number().over(W.partitionBy("session").orderBy("idx"))).where(F.col("nth") <= per_session)
    kept = top.select("session").distinct().orderBy("session").limit(sessions)  # a fixed number of rows
    return top.join(F.broadcast(kept), "session", "left_semi").withColumn("snippet", snippet(F.col("text"), query)).drop("text")


def search_extent(rows: DataFrame, query: str, sessions: int = SESSIONS) -> DataFrame:
    """One row (found, shown, truncated): how many sessions have a match, how many a capped search shows, and whether it shows fewer."""
    hits = rows.where(find(F.col("text"), checked(query)) > 0).agg(F.countDistinct("session").alias("found"))
    return hits.select("found", F.least("found", F.lit(sessions).cast("long")).alias("shown"), (F.col("found") > sessions).alias("truncated"))


def _with(value: Column, make) -> Column:
    """make(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _hits(text: Column, needle: str) -> Column:
    """Places, from 0, of a literal in a text, left to right without overlap."""
    n = len(needle)
    gaps = F.transform(F.split(text, "\\Q" + needle + "\\E", -1), lambda part: F.length(part))
    # A hit starts after all gaps before it and as many hits.
    put = lambda acc, gap: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + n, F.lit(0)) + gap)
    return _with(gaps, lambda g: F.aggregate(F.slice(g, F.lit(1), F.size(g) - 1), F.array().cast("array<int>"), put))


def _own_ranges(text: Column, needle: str) -> Column:
    """Ranges in the characters of a text some of which are longer in lower case.

    Those characters, few in a text, are listed with where they begin in lower
    case, so a place there is found again without a list of all. A hit reaches
    from the character that holds its first place to the one that holds its
    last, and hits that meet in one become one range.
    """
    n, range_, wide_ = len(needle), "array<struct<start:int,end:int>>", "array<struct<begin:int,more:int,sum:int>>"
    chars = F.split(text, "(?s)(?!^)")
    listed = F.filter(F.transform(chars, lambda c, i: F.struct(i.alias("at"), (F.length(F.lower(c)) - F.length(c)).alias("more"))), lambda x: x["more"] > 0)
    before = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["sum"], F.lit(0))
    wide = F.aggregate(listed, F.array().cast(wide_), lambda acc, x: F.array_append(acc, F.struct((x["at"] + before(acc)).alias("begin"), x["more"].alias("more"), (before(acc) + x["more"]).alias("sum"))))

    def mapped(x: Column) -> Column:
        holds = lambda place: place - F.aggregate(x["wide"], F.lit(0), lambda acc, w: acc + F.greatest(F.lit(0), F.least(place - w["begin"], w["more"])))
        whole = F.transform(_hits(x["low"], needle), lambda at: F.struct(holds(at).alias("start"), (holds(at + n - 1) + 1).alias("end")))
        last = lambda acc: F.try_element_at(acc, F.lit(-1))
        joined = lambda acc, r: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], r["end"]).alias("end"))))
        met = F.aggregate(whole, F.array().cast(range_), lambda acc, r: F.when(r["start"] < F.coalesce(last(acc)["end"], F.lit(-1)), joined(acc, r)).otherwise(F.array_append(acc, r)))
        return F.transform(met, lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("length")))

    return _with(F.struct(F.array_join(F.transform(chars, lambda c: F.lower(c)), "").alias("low"), wide.alias("wide")), mapped)


def match_ranges(text: Column, query: str) -> Column:
    """(start, length) of each hit of a query, left to right without overlap, from 0, in the text's own characters.

    The case of every letter is ignored, and blanks around the query. A hit
    within a character that is longer in lower case takes it whole, and hits that
    meet in one character are one range. A blank query has no hits, a null text a null list.
    """
    needle = query.strip().lower()
    if not needle:
        return F.when(text.isNotNull(), F.array().cast("array<struct<start:int,length:int>>"))
    plain = F.transform(_hits(F.lower(text), needle), lambda at: F.struct(at.alias("start"), F.lit(len(needle)).alias("length")))
    # Most texts keep their width; then a place in lower case is the text's own.
    return F.when(F.length(F.lower(text)) != F.length(text), _own_ranges(text, needle)).when(text.isNotNull(), plain)


def occurrences(text: Column, query: str) -> Column:
    """How often a query occurs without overlap, case of A-Z ignored."""
    folded = ascii_lower(text)
    return ((F.length(folded) - F.length(F.replace(folded, F.lit(query.lower())))) / len(query)).cast("long")


def words_plain(text: Column) -> Column:
    """Words in lower case without marks, with a blank before each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^\\p{L}\\p{N}]+", " "))


def registry_search(rows: DataFrame, query: str, columns: tuple[str, ...], narrow: tuple[str, ...]) -> DataFrame:
    """Rows that hold a query.

    Below three characters it is a literal in any column. Of letters, digits
    and blanks only, it is the head of words in a row, marks and case ignored,
    or a literal in any column; otherwise a literal in any column, or in the
    narrow ones for what an index of content misses.
    """
    query = query.strip()
    has = lambda cs: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False)) for c in cs])
    if len(query) < 3:
        return rows.where(has(columns))
    if all(c.isalnum() or c.isspace() for c in query):
        start = " " + " ".join(query.lower().translate(str.maketrans(MARKED, PLAIN)).split())
        phrase = reduce(lambda a, b: a | b, [F.coalesce(F.contains(words_plain(F.col(c)), F.lit(start)), F.lit(False)) for c in columns])
        return rows.where(phrase | has(columns))
    return rows.where(has(columns) | has(narrow))


def newest_hits(rows: DataFrame, limit: int) -> DataFrame:
    """Hits by last change, then by id."""
    return rows.orderBy(F.desc(F.coalesce("updated_at", "created_at", F.lit(0))), "id").limit(limit)


def ascii_fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def session_filter(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of a session whose columns together hold a query in any case."""
    return rows.where(F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(query.lower())))


def next_hits(rows: DataFrame, hit: Column) -> DataFrame:
    """Each row with the nearest hit after and before it, and the hit after the last is the first again."""
    w = W.partitionBy("session").orderBy("idx")
    place = F.when(hit, F.col("idx"))
    after = F.min(place).over(W.partitionBy("session").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1))
    before = F.max(place).over(w.rowsBetween(W.unboundedPreceding, -1))
    first, last = (f(place).over(W.partitionBy("session")) for f in (F.min, F.max))
    return rows.withColumn("next_hit", F.coalesce(after, first)).withColumn("previous_hit", F.coalesce(before, last))


def highlighted(text: Column, query: str, ranges: Column | None = None) -> Column:
    """A text's parts in turn, (part, hit): the letters as they are, hits of the query in any case marked (see match_ranges).

    Parts joined are the text again. A blank query, or one without a hit,
    gives the whole text as one part; a null text a null list. ``ranges`` may be
    given where a column has them already, which is planned faster.
    """
    cut = lambda start, end, hit: F.struct(F.substr(text, start + 1, end - start).alias("part"), F.lit(hit).alias("hit"))

    def parts(ranges: Column) -> Column:
        end = lambda i: F.coalesce(F.try_element_at(ranges, i)["start"] + F.try_element_at(ranges, i)["length"], F.lit(0))
        # A part before each hit begins where the hit before ends; the first one at the start.
        before = lambda r, i: cut(F.when(i > 0, end(F.greatest(i, F.lit(1)))).otherwise(0), r["start"], False)
        pieces = F.flatten(F.transform(ranges, lambda r, i: F.array(before(r, i), cut(r["start"], r["start"] + r["length"], True))))
        rest = F.array(cut(end(F.lit(-1)), F.length(text), False))
        return F.filter(F.concat(pieces, rest), lambda x: x["part"] != "")

    whole = F.array(F.struct(text.alias("part"), F.lit(False).alias("hit")))
    told = (lambda r: F.when(F.size(r) > 0, parts(r)))(ranges) if ranges is not None else _with(match_ranges(text, query), lambda r: F.when(F.size(r) > 0, parts(r)))
    return F.coalesce(told, F.when(text.isNotNull(), whole))


def eligible_indices(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """The rows that a search may look at, numbered from 0 in each session: kinds that are shown, with some text."""
    kept = rows.where(F.col("kind").isin(kinds) & (F.trim("text") != ""))
    return kept.withColumn("nth", F.row_number().over(W.partitionBy("session").orderBy("idx")) - 1)

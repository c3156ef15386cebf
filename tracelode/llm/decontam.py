"""Benchmark passages in documents, exact or with a few edits.

An item of m characters may differ by k edits. Cut into k + 1 pieces it has, by
the pigeonhole principle, a piece without an edit wherever it occurs. One
automaton finds all pieces of all items in a pass over a text; around every hit
the least edit distance of the item is computed by Myers' bit-parallel method.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

#: Edits allowed for a hundred characters of an item.
PERCENT = 5
#: Bytes of items that one pass looks for; more items take more passes.
PASS_BYTES = 4_000_000


def plain(text: str | None) -> str:
    """Lower case, with single blanks for white space."""
    return " ".join((text or "").lower().split())


def budget(item: str, percent: int = PERCENT) -> int:
    """Edits that an item may differ by, by one rule for every length."""
    return len(item) * percent // 100


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their places."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of the item in the text, the leftmost end of equal ones; None beyond k edits."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (k + 1, 0)
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq) & full
        hp = minus | (full & ~(d | plus))
        hn = plus & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        plus, minus = hn | (full & ~(x | hp)), hp & x
        if score < best[0]:
            best = (score, j)
    return best if best[0] <= k else None


class Matcher:
    """All items of a pass."""

    def __init__(self, items: tuple[tuple[int, str], ...], percent: int) -> None:
        self.items = [(name, text, budget(text, percent)) for name, text in items]
        self.found = ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, k) in enumerate(self.items):
            for place, piece in pieces(text, k):
                uses.setdefault(piece, []).append((at, place))
        for piece, where in uses.items():
            self.found.add_word(piece, (len(piece), where))
        if uses:
            self.found.make_automaton()
        self.verify = lru_cache(maxsize=20_000)(self._verify)

    def _verify(self, at: int, window: str) -> tuple[int, int] | None:
        _, text, k = self.items[at]
        return myers(text, window, k)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end) of the best occurrence of each item in the plain text; ends are in its characters."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.found.iter(text):
            for at, place in where:
                _, item, k = self.items[at]
                start = end + 1 - size - place
                a, b = max(0, start - k), min(len(text), start + len(item) + k)
                spans = windows.setdefault(at, [])
                if spans and a <= spans[-1][1] and a >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        out = []
        for at, spans in sorted(windows.items()):
            best = min(((hit[0], a + hit[1]) for a, b in spans if (hit := self.verify(at, text[a:b]))), default=None)
            if best:
                out.append((self.items[at][0], *best))
        return out


@lru_cache(maxsize=4)
def matcher(items: tuple[tuple[int, str], ...], percent: int) -> Matcher:
    return Matcher(items, percent)


def passes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = PASS_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in groups whose texts have a bounded size, so that each may be sent to every task."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // most))
    for g in range(groups):
        part = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g)
        found = tuple(sorted({(r.id, t) for r in part.collect() if (t := plain(r.text))}))
        if found:
            yield found


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, most: int = PASS_BYTES) -> DataFrame:
    """(id, item_id, distance, end) for every row of docs and every item that occurs in it.

    Texts and items are compared in lower case with single blanks. An item of m
    characters occurs where some stretch is within m * percent // 100 edits of
    it, be the item long or short and the stretch part of a word or not; distance
    is the least of all stretches, end where the first of those ends, in
    characters of the compared text. Null texts and items and blank items match
    nothing; texts are read to their end. Repeated rows are told apart by
    nothing and give the same pairs again; a null id stays null. Empty tables
    give an empty result; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    schema = f"id {kind}, item_id long, distance int, end int"
    out = docs.sparkSession.createDataFrame([], schema)
    for group in passes(items, item_id, item_text, most):

        def run(batches: Iterator[pd.DataFrame], group=group) -> Iterator[pd.DataFrame]:
            find = matcher(group, percent).matches
            for batch in batches:
                rows = [(i, *hit) for i, text in zip(batch["id"], batch["text"], strict=True) for hit in find(plain(text))]
                yield pd.DataFrame(rows, columns=["id", "item_id", "distance", "end"])

        out = out.unionByName(rows.mapInPandas(run, schema))
    return out.withColumnRenamed("id", id_col)


def _clean(group: tuple[tuple[int, str], ...], percent: int):
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        find = matcher(group, percent).matches
        return pd.Series([not find(plain(t)) for t in texts], dtype=bool)

    return clean


def drop_leaking(docs: DataFrame, items: DataFrame, text_col: str = "text", percent: int = PERCENT, most: int = PASS_BYTES) -> DataFrame:
    """docs without the rows in which a benchmark item occurs; columns stay, null texts too."""
    for group in passes(items, most=most):
        docs = docs.where(_clean(group, percent)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

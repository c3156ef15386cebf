"""Secret scans by one combined deterministic automaton."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Rule, scanner
from .common import documents

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]"
_BEFORE_VALUE = re.compile(ASSIGN, re.ASCII)


def _long_value(match: str) -> bool:
    return len(match) - _BEFORE_VALUE.match(match).end() >= 12


class AtLeast:
    """Accepts a match of so many characters or more."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __call__(self, match: str) -> bool:
        return len(match) >= self.size

    def __eq__(self, other: object) -> bool:
        return isinstance(other, AtLeast) and other.size == self.size

    def __hash__(self) -> int:
        return hash(self.size)


BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", f"{ASSIGN}{VALUE}+", f"{ASSIGN}{VALUE}", _long_value),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", AtLeast(18)),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{16}"),
    Rule("pem", "-----BEGIN[A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsru]_[A-Za-z0-9]+", "gh[opsru]_[A-Za-z0-9]", AtLeast(40)),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]", AtLeast(15)),
)


@F.pandas_udf(T.ArrayType(T.StringType()))
def secret_spans(texts: pd.Series) -> pd.Series:
    """kind:start:end of every secret, by start and then in the rules' order."""
    find = scanner(RULES).spans
    return pd.Series([[f"{k}:{a}:{b}" for k, a, b in find(t)] for t in texts])


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """Texts whose secrets are replaced by <secret>; overlapping ones by one mark."""
    find = scanner(RULES).spans

    def clean(text: str) -> str:
        out, done = [], 0
        for _, a, b in find(text):
            if b > done:
                if a >= done:
                    out += [text[done:a], "<secret>"]
                done = b
        return "".join([*out, text[done:]]) if done else text

    return pd.Series([clean(t) for t in texts])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: spans lists kind:start:end in code points.

    A null text is read as an empty one and has no spans. Rows aren't joined
    or grouped, so null and repeated ids and extra columns don't matter.
    """
    return docs.select(id_col, secret_spans(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with every secret in a text replaced by a mark; rows, columns and null texts stay.

    The column of text lengths, where there is one, follows the new text.
    """
    new = F.when(F.col(text_col).isNotNull(), redacted(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = docs.withColumn(text_col, new)
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        out = out.withColumn(size_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(size_col)))
    return out.select(docs.columns)


def _of(kinds: tuple[str, ...]) -> Column:
    return F.filter("spans", lambda x: F.substring_index(x, ":", 1).isin(*kinds))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(_of((k,))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(_of(BASE), ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


def _duck_spans(order: int, kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind in DuckDB: starts are sums of the pieces and matches before."""
    p = pattern.replace("'", "''")
    return f"""
  select doc_id, rid, {order} as o, '{kind}' as kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
    'a': list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
    'm': m[i]}}), lambda x: {keep})) as x
  from (select doc_id, rid, string_split_regex(t, '{p}') as s, regexp_extract_all(t, '{p}', 0) as m from d)"""


_SQL_RULES = [
    ("assign", rf"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?{VALUE}+""", "length(regexp_extract(x.m, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?(.*)$', 1)) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "length(x.m) >= 18"),
    ("hex", "[0-9a-f]+", "length(x.m) >= 16"),
    ("pem", "-----BEGIN[A-Z ]*PRIVATE KEY-----", "true"),
    ("github", "gh[opsru]_[A-Za-z0-9]+", "length(x.m) >= 40"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(x.m) >= 15"),
]

OP3_SQL = f"""
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents),
f as ({" union all ".join(_duck_spans(o, *r) for o, r in enumerate(_SQL_RULES))}),
g as (select rid, o, kind, cast(x.a as bigint) as a, kind || ':' || cast(x.a as bigint) || ':' || cast(x.a + length(x.m) as bigint) as s from f)
select any_value(d.doc_id) as doc_id,
  count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(s, ',' order by a, o) filter (o < 3), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by a, o), '') as spans
from d left join g on d.rid = g.rid group by d.rid"""

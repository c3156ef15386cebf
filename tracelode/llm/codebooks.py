"""Compact codes of vectors: one codebook a part, fitted and assigned in integers.

Components become integers and a vector is cut into equal parts. Each part
position has a codebook, fitted by rounds over all vectors: a task assigns its
rows and gives back one sum for each entry and position, so what is shuffled and
what the driver holds is as large as the codebooks, whatever the table holds.

The nearest entry is found by segment means. The mean of a block of components
and the norm of what is left around it bound a squared distance from below: by
both for one block as long as the part, then for two halves, then for quarters.
An entry whose bound is above the exact distance to the most promising entry
can't be nearest; those left get exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stash

SCALE, PARTS, ENTRIES, ROUNDS = 4_096, 8, 16, 6
#: Components beyond are counted as this, so that they and their sums stay exact.
EDGE = 1 << 62
#: What square roots and products of doubles may be off, with a wide margin.
SLACK = 1e-12
#: The least long; errors have to be below its negative.
LONG = 1 << 63


def segments(width: int) -> list[np.ndarray]:
    """Where blocks begin, coarse to fine: one block, two, four and so on, of two components at least."""
    found, blocks = [], 1
    while blocks == 1 or 2 * blocks <= width:
        found.append(np.arange(blocks) * width // blocks)
        blocks *= 2
    return found


def outline(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum, norm of what is left around the mean, length) of each block; the norm is times the root of the length."""
    length = np.diff(np.append(begin, x.shape[1]))
    sums = np.add.reduceat(x, begin, axis=1)
    around = length * np.add.reduceat(x * x, begin, axis=1) - sums * sums  # exact, and never negative
    return sums, np.sqrt(around.astype(np.float64)), length


def bound(sums: np.ndarray, left: np.ndarray, sums2: np.ndarray, left2: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number that the squared distance isn't below, from outlines along the last axis."""
    apart = np.maximum(0.0, np.abs(left - left2) - SLACK * (left + left2))
    means = (sums - sums2).astype(np.float64)
    return ((means * means + apart * apart) / length).sum(axis=-1) * (1 - SLACK)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of integers; ties go to the lower index."""
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    if max(abs(int(x.min())), abs(int(x.max())), abs(int(entries.min())), abs(int(entries.max()))) * width >= 1 << 30:
        # Squares would not fit a long: whole numbers of any size, without bounds.
        far = np.stack([exact(x.astype(object), e) for e in entries.astype(object)], axis=1)
        index = np.array([min(range(len(r)), key=r.__getitem__) for r in far.tolist()])
        return index, far[np.arange(n), index]
    coarse, *finer = segments(width)
    (s, r, length), (s2, r2, _) = outline(x, coarse), outline(entries, coarse)
    low = bound(s[:, None], r[:, None], s2[None], r2[None], length)
    best = exact(x, entries[low.argmin(axis=1)])
    row, entry = np.nonzero(low <= best[:, None])
    for begin in finer:
        (s, r, length), (s2, r2, _) = outline(x, begin), outline(entries, begin)
        open_ = bound(s[row], r[row], s2[entry], r2[entry], length) <= best[row]
        row, entry = row[open_], entry[open_]
    far = exact(x[row], entries[entry])
    order = np.lexsort((entry, far, row))
    first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
    return entry[first], far[first]


def _cut(rows: pd.Series, parts: int) -> list[np.ndarray]:
    x = np.array(rows.tolist(), np.int64).reshape(len(rows), -1)
    return np.split(x, parts, axis=1)


def _sums(books: list[np.ndarray]):
    """A mapInPandas function: of all vectors of a task, how many each entry is nearest to, and the sums of their components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for part, x in enumerate(_cut(batch["ints"], len(books))):
                index, _ = nearest(x, books[part])
                count[part] += np.bincount(index, minlength=len(count[part]))
                wide = x if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object)
                for e in np.unique(index).tolist():
                    total[part][e] += wide[index == e].sum(axis=0)
        yield pd.DataFrame(
            [(p, e, at, int(count[p][e]), Decimal(int(t))) for p, sums in enumerate(total) for e, row in enumerate(sums) if count[p][e] for at, t in enumerate(row)],
            columns=["part", "entry", "at", "n", "total"],
        )

    return run


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of (id, ints), all of one width that parts divides: an array of entries for each part.

    They start as the vectors with the least ids, a null id last and equal ids
    by their components. Fewer vectors than entries give fewer entries.
    """
    first = ints.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").toPandas()
    books = _cut(first["ints"], parts)
    for _ in range(rounds):
        sums = ints.select("ints").mapInPandas(_sums(books), "part int, entry int, at int, n long, total decimal(38,0)")
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # at most as many as the codebooks have components
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()


def _coded(books: list[np.ndarray]):
    @F.pandas_udf("code string, error long")
    def run(ints: pd.Series) -> pd.DataFrame:
        found = [nearest(x, book) for x, book in zip(_cut(ints, len(books)), books, strict=True)]
        codes = np.array([index for index, _ in found]).T.astype(int)
        errors = [sum(int(d) for d in row) for row in zip(*(far.tolist() for _, far in found), strict=True)]
        return pd.DataFrame({"code": ["".join(f"{c:02x}" for c in row) for row in codes.tolist()], "error": pd.array([e if e < LONG else None for e in errors], "Int64")})

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every vector that is whole.

    Rows whose vector is null or holds null or non-finite numbers are left out.
    The others all count, repeated ones as often as they stand there and those
    with a null id too; equal distances go to the lower entry. Vectors of
    another width have codebooks of their own. One that can't be cut into equal
    parts has a null code and error, and an error beyond a long is null; label_error
    sums those there are, over rows of an equal label, null ones together. An
    empty table gives an empty result; other columns are not looked at.
    """
    v = F.col("vec")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec")).where(v.isNotNull() & F.forall(v, fine))
    near = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-EDGE))), F.lit(float(EDGE)))).cast("long")
    ints = stash(whole.select("id", "label", F.transform("vec", near).alias("ints")), "ints")
    tables = []
    for row in ints.groupBy(F.size("ints").alias("width")).count().collect():
        some, made = ints.where(F.size("ints") == row["width"]), (F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("string"))
        if row["width"] % parts == 0:
            books = fit(some, parts, entries, rounds)
            some = some.withColumn("made", _coded(books)("ints"))
            made = (F.col("made.code"), F.col("made.error"), F.lit(digest(books)))
        tables.append(some.select("id", "label", made[0].alias("code"), made[1].alias("error"), made[2].alias("codebooks_sha256")))
    if not tables:
        return ints.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stash(reduce(DataFrame.unionByName, tables), "coded")
    by_label = stash(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(F.col("label").alias("of"), F.expr("try_cast(total as long)").alias("label_error")), "labels")
    small = F.broadcast(by_label) if by_label.count() <= BROADCAST_ROWS else by_label
    return coded.join(small, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def op13_codebooks(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds written out one after another, every part against every entry."""
    assigned = """a{k} as materialized (
  select vec_id, part, entry, d from (
    select vec_id, part, entry, sum((v - c) * (v - c)) as d from parts join b{k} using (part, pos) group by vec_id, part, entry)
  qualify row_number() over (partition by vec_id, part order by d, entry) = 1)"""
    moved = """b{n} as materialized (
  select o.part, o.entry, o.pos, coalesce(m.c, o.c) as c from b{k} o left join (
    select part, entry, pos, cast((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) / count(*) as bigint) as c
    from a{k} join parts using (vec_id, part) group by part, entry, pos) m using (part, entry, pos))"""
    rounds = ",\n".join(part.format(k=k, n=k + 1) for k in range(ROUNDS) for part in (assigned, moved))
    return f"""with kept as materialized (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, p // (len(embedding) // {PARTS}) as part, p % (len(embedding) // {PARTS}) as pos,
    cast(floor({SCALE} * cast(embedding[p + 1] as double)) as bigint) as v
  from kept, unnest(range(len(embedding))) as t(p)),
firsts as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {ENTRIES}),
b0 as materialized (select part, entry, pos, v as c from parts join firsts using (vec_id)),
{rounds},
{assigned.format(k=ROUNDS)},
codes as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by vec_id),
by_label as (select label, cast(sum(error) as bigint) as label_error from kept join codes using (vec_id) group by label)
select k.vec_id, code, error, label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) from b{ROUNDS}) as codebooks_sha256
from kept k join codes using (vec_id) join by_label l on k.label is not distinct from l.label"""


OP13_SQL = _sql()

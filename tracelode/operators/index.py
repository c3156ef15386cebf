"""A search index that is written once and read by buckets.

Three Parquet folders beside each other: the rows by id, postings (gram, ids) of
all different trigrams and postings (word, id) of all different words. A row of
grams holds the ids of the rows with it among some that lay side by side, so that
there are far fewer than letters in the texts. Postings lie in folders by a hash
of the gram, or of a word's first letter, sorted, so that a search reads the
folders and row groups of what it asks for. Rows that come later are appended.

A search takes the rarest of a query's trigrams, intersects their postings, adds
rows by words where the query may be the head of words, and looks at the texts
of those candidates alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import batches_of
from .search import MARKED, PLAIN, checked, find, registry_search, words_plain

BUCKETS, WORD_BUCKETS = 64, 32
#: Trigrams of a query whose postings are read.
RAREST = 3
#: Candidates whose ids are sent with the scan of the rows; more are joined.
LISTED = 10_000
#: Trigrams that a task turns into postings at once, and rows that it is handed at once.
LETTERS, HANDED = 1_000_000, 200
#: Parts into which the postings of a bucket are dealt, by a hash of the key.
PARTS = 8
#: Bytes of a row group of the rows, so that few texts are read besides a candidate's.
ROW_GROUP = 1 << 20


def folded(text: str) -> str:
    """A query as texts are indexed: lower case, a final sigma like any other."""
    return text.lower().replace("ς", "σ")


def _folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def grams(query: str) -> list[str]:
    q = folded(query)
    return sorted({q[i : i + 3] for i in range(len(q) - 2)})


def _codes(text: str) -> np.ndarray:
    """The different trigrams of a text as sorted numbers of three times 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


@F.pandas_udf(T.StringType())
def _gram(codes: pd.Series) -> pd.Series:
    return codes.map(lambda n: chr(n >> 42) + chr(n >> 21 & 0x1FFFFF) + chr(n & 0x1FFFFF))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, texts) to (code, ids): for each trigram the ids of rows that have it, among so many that their trigrams fill LETTERS.

    What is held is bounded by LETTERS and one row's texts, whatever a batch has.
    """

    def told(codes: list[np.ndarray], ids: list[pa.Array]) -> pa.RecordBatch:
        every = np.concatenate(codes)
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(every)].astype(np.int32)), pa.concat_arrays(ids).take(pa.array(row[order])))
        return pa.RecordBatch.from_arrays([pa.array(every[first]), lists], ["code", "ids"])

    codes: list[np.ndarray] = []
    ids: list[pa.Array] = []
    held = 0
    for batch in batches:
        for at in range(batch.num_rows):
            texts = [_codes(t) for t in batch.column("texts")[at].as_py() if len(t) > 2]
            if texts:
                codes.append(np.unique(np.concatenate(texts)) if len(texts) > 1 else texts[0])
                ids.append(batch.column("id").slice(at, 1))
                held += len(codes[-1])
            if held > LETTERS:
                yield told(codes, ids)
                codes, ids, held = [], [], 0
    if codes:
        yield told(codes, ids)


def _bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets)).cast("int")


def _bucket_of(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode()) % buckets


class Index:
    """The index of rows with an id and some text columns under a path."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, columns: Sequence[str]) -> None:
        self.spark, self.path, self.id_col, self.columns = spark, path.rstrip("/"), id_col, list(columns)

    def complete(self) -> bool:
        """Whether a build ended; words are written last."""
        jvm = self.spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/words/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def _write(self, rows: DataFrame, mode: str) -> None:
        kept = rows.select(self.id_col, *self.columns)
        kept.repartitionByRange(self.id_col).sortWithinPartitions(self.id_col).write.mode(mode).option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/rows")
        some = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.columns]
        kind = kept.schema[self.id_col].dataType.simpleString()
        with batches_of(self.spark, HANDED):
            grams = kept.select(F.col(self.id_col).alias("id"), F.array(*map(_folded, some)).alias("texts")).mapInArrow(_grams, f"code long, ids array<{kind}>")
            self._postings(grams.select(_gram("code").alias("gram"), "ids"), "gram", F.col("gram"), BUCKETS, "grams", mode)
        all_words = reduce(F.array_union, [F.split(F.trim(words_plain(c)), " ") for c in some])
        words = kept.select(F.explode(all_words).alias("word"), self.id_col).where("word <> ''")
        self._postings(words, "word", F.substr("word", F.lit(1), F.lit(1)), WORD_BUCKETS, "words", mode)

    def _postings(self, rows: DataFrame, key: str, by: Column, buckets: int, folder: str, mode: str) -> None:
        """Dealt by bucket and parts of it, so that what gives the postings is computed once, with no sample before; each file is sorted by key."""
        placed = rows.withColumn("bucket", _bucket(by, buckets)).repartition("bucket", F.pmod(F.xxhash64(key, rows.columns[1]), F.lit(PARTS))).sortWithinPartitions("bucket", key)
        placed.write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def build(self, rows: DataFrame) -> Index:
        """Write the index of these rows; what was there goes."""
        self._write(rows, "overwrite")
        return self

    def append(self, rows: DataFrame) -> Index:
        """Add rows whose ids aren't in the index; those that are stay as they were indexed."""
        known = self.rows().select(self.id_col)
        self._write(rows.join(known, self.id_col, "left_anti"), "append")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _all(self, folder: str, key: str) -> DataFrame:
        """The postings; a schema is given, as an index of no rows has no files."""
        kind = self.rows().schema[self.id_col].dataType.simpleString()
        held = f"ids array<{kind}>" if folder == "grams" else f"`{self.id_col}` {kind}"
        return self.spark.read.schema(f"{key} string, {held}, bucket int").parquet(f"{self.path}/{folder}")

    def _of(self, folder: str, key: str, buckets: set[int], test: Column) -> DataFrame:
        return self._all(folder, key).where(F.col("bucket").isin(sorted(buckets)) & test)

    def gram_counts(self) -> DataFrame:
        """(gram, n): in how many rows each trigram is."""
        return self._all("grams", "gram").groupBy("gram").agg(F.sum(F.size("ids")).cast("long").alias("n"))

    def by_grams(self, query: str) -> DataFrame:
        """Ids of rows that hold the rarest trigrams of a query."""
        asked = grams(query)
        found = self._of("grams", "gram", {_bucket_of(g, BUCKETS) for g in asked}, F.col("gram").isin(asked))
        often = {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row for each trigram of the query at most
        rarest = sorted(asked, key=lambda g: often.get(g, 0))[:RAREST]
        if not all(g in often for g in rarest):
            return self.rows().select(self.id_col).limit(0)
        some = self._of("grams", "gram", {_bucket_of(g, BUCKETS) for g in rarest}, F.col("gram").isin(rarest))
        some = some.select("gram", F.explode("ids").alias(self.id_col))
        return some.groupBy(self.id_col).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select(self.id_col)

    def by_words(self, query: str) -> DataFrame:
        """Ids of rows that have the words of a query, the last one as the head of a word."""
        *words, last = query.lower().translate(str.maketrans(MARKED, PLAIN)).split()
        heads = {_bucket_of(w[0], WORD_BUCKETS) for w in (*words, last)}
        head = F.col("word").startswith(last)
        some = self._of("words", "word", heads, F.col("word").isin(words) | head)
        fits = F.count_distinct(F.when(F.col("word").isin(words), F.col("word"))) == len(set(words))
        return some.groupBy(self.id_col).agg(fits.alias("fits"), F.max(head).alias("head")).where("fits and head").select(self.id_col)

    def texts(self, ids: DataFrame) -> DataFrame:
        """Rows of these ids: a bounded number is sent with the scan, which skips other row groups."""
        listed = sorted(r[0] for r in ids.distinct().limit(LISTED + 1).collect())
        if len(listed) <= LISTED:
            return self.rows().where(F.col(self.id_col).isin(listed))
        return self.rows().join(ids.distinct(), self.id_col, "left_semi")

    def literal(self, query: str, column: str) -> DataFrame:
        """Rows whose column holds a query of two characters or more (see search.find)."""
        query = checked(query)
        rows = self.rows() if len(query) < 3 else self.texts(self.by_grams(query))
        # A test that a null passes through, so that ids alone are what the scan is asked for.
        return rows.where(F.coalesce(find(F.col(column), query), F.lit(0)) > 0)

    def registry(self, query: str, columns: tuple[str, ...], narrow: tuple[str, ...]) -> DataFrame:
        """As search.registry_search; only a query under three characters has all rows looked at."""
        query = query.strip()
        if len(query) < 3:
            return registry_search(self.rows(), query, columns, narrow)
        ids = self.by_grams(query)
        if all(c.isalnum() or c.isspace() for c in query):
            ids = ids.unionByName(self.by_words(query))
        return registry_search(self.texts(ids), query, columns, narrow)


def stamp(df: DataFrame) -> str:
    """A name for the files behind a table: another one if a file is added, grows or is written anew."""
    jvm, told = df.sparkSession._jvm, []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(path)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return f"{zlib.crc32(chr(10).join(told).encode()):08x}-{len(told)}"

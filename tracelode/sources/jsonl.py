"""Session logs of one JSON object a line, as rows with file and line number.

Spark reads a log whole where the order of its lines counts, and numbers the
lines there; files are dealt out over the cluster. Very many small logs are
packed, a row a log, as a file costs the same whatever its size. Bad lines are
kept, dropped or refused by policy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLICIES = ("strict", "tolerant", "tolerant_unless_all_bad")


def lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.jsonl", deep: bool = True) -> DataFrame:
    """(path, line_no, value) of every line that isn't blank, numbered from 0 as in the file; below all folders, or right in the given ones."""
    reader = spark.read.option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", glob)
    return _numbered(reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def _numbered(logs: DataFrame) -> DataFrame:
    return logs.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "value")).where(F.trim("value") != "")


def pack(rows: DataFrame, path: str) -> None:
    """Write logs as rows (path, content) of Parquet files; rows have the log's path, line, by which its lines are sorted, and value, one line's text or null for a blank one."""
    each = F.array_sort(F.collect_list(F.struct("line", F.coalesce("value", F.lit("")).alias("value"))))
    rows.groupBy("path").agg(F.array_join(F.transform(each, lambda x: x["value"]), "\n").alias("content")).write.parquet(path)


def packed_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """As lines, of logs that were packed."""
    return _numbered(spark.read.schema("path string, content string").parquet(*([path] if isinstance(path, str) else path)))


def parsed(rows: DataFrame, policy: str = "tolerant") -> DataFrame:
    """rows with the column json, a variant, null for a bad line.

    strict raises on a bad line when it is reached, tolerant drops bad lines,
    tolerant_unless_all_bad keeps a file's last one if it has no good one, so
    that ``broken_files`` finds it.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    if policy == "strict":
        return rows.withColumn("json", F.parse_json("value"))
    read = rows.withColumn("json", F.try_parse_json("value"))
    if policy == "tolerant":
        return read.where(F.col("json").isNotNull())
    good = read.groupBy("path").agg(F.count("json").alias("good"), F.max("line_no").alias("last"))
    return read.join(good, "path").where(F.col("json").isNotNull() | (F.col("good") == 0) & (F.col("line_no") == F.col("last"))).drop("good", "last")


def validation(rows: DataFrame) -> DataFrame:
    """(path, n_lines, n_bad, ok) by file: all lines parse and there is one at least."""
    bad = F.try_parse_json("value").isNull().cast("long")
    return rows.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(bad).alias("n_bad")).withColumn("ok", F.col("n_bad") == 0)


def text_at(path: str, column: str = "json") -> Column:
    """A string at a path of a variant; null for other kinds."""
    found = F.try_variant_get(column, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(column, path, "string"))


def long_at(path: str, column: str = "json") -> Column:
    return F.try_variant_get(column, path, "bigint")


def flag_at(path: str, column: str = "json") -> Column:
    return F.coalesce(F.try_variant_get(column, path, "boolean"), F.lit(False))


def content_text(path: str, column: str = "json", types: Sequence[str] = ("text", "input_text", "output_text")) -> Column:
    """Text of a content that is a string or an array of blocks with type and text; blocks are joined by a blank line."""
    blocks = F.try_variant_get(column, path, "array<variant>")
    kind = lambda b: F.try_variant_get(b, "$.type", "string")
    fine = F.filter(blocks, lambda b: kind(b).isin(*types) & F.try_variant_get(b, "$.text", "string").isNotNull())
    joined = F.array_join(F.transform(fine, lambda b: F.try_variant_get(b, "$.text", "string")), "\n\n")
    return F.coalesce(text_at(path, column), joined, F.lit(""))


def seconds_at(path: str, column: str = "json") -> Column:
    """Epoch seconds of a time that is RFC 3339 text or a number; numbers above 1e12 are milliseconds."""
    number = F.try_variant_get(column, path, "double")
    as_text = text_at(path, column)
    stamp = F.unix_timestamp(F.try_to_timestamp(as_text))
    return F.when(as_text.isNotNull(), stamp).otherwise(F.floor(F.when(number > 1e12, number / 1000).otherwise(number)).cast("long"))

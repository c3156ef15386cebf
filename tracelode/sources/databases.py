"""Tables of SQLite files as a data source, and sessions from them.

Every file is read in ranges of rowids, a task each. A column that a file lacks
is null: foreign databases come in many versions. Files must lie where all
executors reach them.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructType
from pyspark.sql.window import Window as W

from .jsonl import text_at

ROWS = 50_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class SqliteSource(DataSource):
    """Format ``sqlite_table``; options path (a file, folder or pattern), table and rows a task."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("sqlite_table needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.wanted, self.table = schema, options["table"]
        path = options["path"].removeprefix("file://")
        self.paths = sorted(glob.glob(os.path.join(path, "*.db") if os.path.isdir(path) else path))
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for path in self.paths:
            with _open(path) as db:
                if not db.execute("select 1 from sqlite_master where name = ?", (self.table,)).fetchone():
                    continue
                first, last = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            if first is not None:
                found += [_Range(path, a, min(last, a + self.rows - 1)) for a in range(first, last + 1, self.rows)]
        return found or [_Range("", 0, -1)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        with _open(part.path) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            have = {r[1] for r in db.execute(f"pragma table_info({_quoted(self.table)})")} | {"rowid"}
            names = [_quoted(f.name) if f.name in have else ("?1" if f.name == "_path" else "null") for f in self.wanted.fields]
            for row in db.execute(f"select {', '.join(names)} from {_quoted(self.table)} where rowid between ?2 and ?3 and ?1 = ?1 order by rowid", (part.path, part.first, part.last)):
                yield tuple(_as(v, f.dataType) for v, f in zip(row, self.wanted.fields, strict=True))


def _as(value, kind):
    """SQLite is typed by value, Spark by column: what doesn't fit becomes null, or text."""
    if value is None:
        return None
    if isinstance(kind, BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    if isinstance(kind, LongType | DoubleType):
        try:
            return (int if isinstance(kind, LongType) else float)(value)
        except (TypeError, ValueError):
            return None
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def sqlite(spark: SparkSession, path: str, name: str, schema: str, rows: int = ROWS) -> DataFrame:
    """One table of one or many SQLite files; the columns _path and rowid may be asked for."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("table", name).option("rows", rows).load(path)


def codex_threads(spark: SparkSession, path: str, titles: DataFrame | None = None) -> DataFrame:
    """Session rows with the number of their log rows and their title by the index."""
    t = sqlite(spark, path, "threads", "id string, rollout_path string, cwd string, title string, first_user_message string, model string, reasoning_effort string, tokens_used long, created_at long, updated_at long, archived long, source string, agent_nickname string, agent_role string, git_branch string")
    logs = sqlite(spark, path, "logs", "thread_id string").groupBy(F.col("thread_id").alias("id")).agg(F.count("*").alias("logs_count"))
    out = t.join(logs, "id", "left").fillna({"logs_count": 0})
    if titles is not None:
        out = out.join(titles.select("id", F.col("title").alias("index_title")), "id", "left").withColumn("title", F.coalesce("index_title", "title")).drop("index_title")
    return out.withColumn("provider", F.lit("codex")).withColumn("archived", F.coalesce(F.col("archived") != 0, F.lit(False)))


def hermes_events(spark: SparkSession, path: str) -> DataFrame:
    """(session, idx, at, role, text, call): messages and a row for each tool call they make."""
    m = sqlite(spark, path, "messages", "id long, session_id string, role string, content string, timestamp double, tool_calls string, tool_call_id string")
    calls = F.from_json("tool_calls", "array<struct<id: string, function: struct<name: string, arguments: string>>>")
    base = m.select(F.col("session_id").alias("session"), F.col("id").alias("idx"), F.floor("timestamp").cast("long").alias("at"), "role", F.coalesce("content", F.lit("")).alias("text"), F.col("tool_call_id").alias("call"), F.lit(0).alias("part"))
    made = m.select(F.col("session_id").alias("session"), F.col("id").alias("idx"), F.floor("timestamp").cast("long").alias("at"), F.posexplode(calls).alias("n", "c"))
    return base.unionByName(made.select("session", "idx", "at", F.lit("tool_call").alias("role"), F.coalesce("c.function.name", F.lit("")).alias("text"), F.col("c.id").alias("call"), (F.col("n") + 1).alias("part")))


def zcode_events(spark: SparkSession, path: str) -> DataFrame:
    """(session, place, role, kind, text): messages joined to their parts, by sequence, then time; null sequences last."""
    m = sqlite(spark, path, "message", "id string, session_id string, time_created long, data string, sequence long, rowid long")
    p = sqlite(spark, path, "part", "id string, message_id string, session_id string, time_created long, data string, sequence long")
    both = m.alias("m").join(p.alias("p"), (F.col("m.id") == F.col("p.message_id")) & (F.col("m.session_id") == F.col("p.session_id")))
    order = [F.col("m.sequence").asc_nulls_last(), F.col("m.time_created"), F.col("m.rowid"), F.col("p.sequence").asc_nulls_last(), F.col("p.time_created"), F.col("p.id")]
    kind = F.get_json_object("p.data", "$.type")
    role = F.when(kind == "tool", "tool_call").when(kind == "reasoning", "reasoning").when(kind == "text", F.get_json_object("m.data", "$.role")).otherwise("meta")
    text = F.coalesce(F.get_json_object("p.data", "$.text"), F.get_json_object("p.data", "$.tool"), F.lit(""))
    return both.select(F.col("m.session_id").alias("session"), F.row_number().over(W.partitionBy("m.session_id").orderBy(*order)).alias("place"), role.alias("role"), kind.alias("kind"), text.alias("text"))


def opencode_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(id, cwd, title, created_at, updated_at, archived, tokens_used, model, first_user_message, bytes) of each session."""
    s = sqlite(spark, path, "session", "id string, directory string, title string, parent_id string, time_created long, time_updated long, time_archived long")
    m = sqlite(spark, path, "message", "id string, session_id string, time_created long, data string").withColumn("json", F.try_parse_json("data"))
    p = sqlite(spark, path, "part", "message_id string, session_id string, data string, time_created long")
    count = lambda key: F.coalesce(F.try_variant_get("json", f"$.tokens.{key}", "long"), F.lit(0))
    used = m.groupBy("session_id").agg(
        F.sum(count("input") + count("output") + count("reasoning") + count("cache.read") + count("cache.write")).alias("tokens_used"),
        F.max_by(text_at("$.modelID"), F.when(text_at("$.modelID").isNotNull(), F.struct("time_created", "id"))).alias("model"),
        F.sum(F.octet_length("data")).cast("long").alias("bytes"),
    )
    users = m.where(text_at("$.role") == "user").select(F.col("id").alias("message_id"), F.col("time_created").alias("_at"))
    first = p.join(users, "message_id").where(F.get_json_object("data", "$.type") == "text").groupBy("session_id").agg(F.min_by(F.get_json_object("data", "$.text"), F.struct("_at", "message_id", "time_created")).alias("first_user_message"))
    out = s.join(used, s["id"] == used["session_id"], "left").drop("session_id").join(first, s["id"] == first["session_id"], "left")
    return out.select("id", F.col("directory").alias("cwd"), "title", F.floor(F.col("time_created") / 1000).alias("created_at"), F.floor(F.col("time_updated") / 1000).alias("updated_at"), F.col("time_archived").isNotNull().alias("archived"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), "model", F.coalesce("first_user_message", F.lit("")).alias("first_user_message"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def cursor_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Composer headers with a title or path and a bubble at least, sub-agents left out."""
    h = sqlite(spark, path, "composerHeaders", "composerId string, workspaceId string, createdAt long, lastUpdatedAt long, isArchived long, isSubagent long, value string")
    kv = sqlite(spark, path, "cursorDiskKV", "key string, value string").where("key like 'composerData:%'")
    bubbles = kv.select(F.substring_index("key", ":", -1).alias("composerId"), F.coalesce(F.json_array_length(F.get_json_object("value", "$.fullConversationHeadersOnly")), F.lit(0)).alias("bubbles"))
    title, cwd = F.get_json_object("value", "$.name"), F.get_json_object("value", "$.workspacePath")
    rows = h.where(F.coalesce("isSubagent", F.lit(0)) == 0).withColumn("title", title).withColumn("cwd", cwd).where("coalesce(trim(title), '') <> '' or coalesce(trim(cwd), '') <> ''")
    return rows.join(bubbles.where("bubbles > 0"), "composerId").select(F.col("composerId").alias("id"), "title", "cwd", F.floor(F.col("createdAt") / 1000).alias("created_at"), F.floor(F.coalesce("lastUpdatedAt", "createdAt") / 1000).alias("updated_at"), F.coalesce(F.col("isArchived") != 0, F.lit(False)).alias("archived"), "bubbles")


"""Formats of session logs as canonical rows.

Inputs are parsed lines (path, line_no, json) of ``jsonl.parsed``; results are
summaries, a row a file, or events, a row a message. Order within a file is
kept by line number, never by where a row happens to be.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..operators import graph
from ..operators.project import claude_events, cut, generated
from .jsonl import content_text, flag_at, long_at, seconds_at, text_at


def _first(value: Column, when: Column | None = None) -> Column:
    """The value of the first line that has one."""
    fine = value.isNotNull() if when is None else value.isNotNull() & when
    return F.min_by(value, F.when(fine, F.col("line_no")))


def _last(value: Column, when: Column | None = None) -> Column:
    fine = value.isNotNull() if when is None else value.isNotNull() & when
    return F.max_by(value, F.when(fine, F.col("line_no")))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def claude_summaries(rows: DataFrame) -> DataFrame:
    """One row a file: id, directory, model, times, tokens and title.

    The title is the first there is of: a given one, one from a hook, a made
    one, a summary, the first prompt, the last prompt, the last text, the
    directory's name, the id.
    """
    kind, text = F.coalesce(text_at("$.type"), F.lit("")), F.trim(content_text("$.message.content"))
    has_message = F.try_variant_get("json", "$.message", "variant").isNotNull()
    user = (kind == "user") | (F.coalesce(text_at("$.message.role"), F.lit("")) == "user")
    visible = has_message & ~flag_at("$.isMeta") & ~flag_at("$.isSidechain") & (text != "")
    parts = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    tokens = sum((F.coalesce(long_at(f"$.{at}usage.{p}"), F.lit(0)) for at in ("message.", "") for p in parts), F.lit(0))
    at = seconds_at("$.timestamp")
    given = lambda *names: F.coalesce(*[F.when(F.trim(text_at(f"$.{n}")) != "", F.trim(text_at(f"$.{n}"))) for n in names])
    found = rows.groupBy("path").agg(
        F.coalesce(_first(text_at("$.sessionId")), F.any_value(_name(F.col("path")))).alias("id"),
        F.coalesce(_first(text_at("$.cwd")), F.lit("")).alias("cwd"),
        _first(F.coalesce(text_at("$.message.model"), text_at("$.model")), has_message).alias("model"),
        F.coalesce(_first(at), F.lit(0)).alias("created_at"),
        F.coalesce(_last(at), F.lit(0)).alias("updated_at"),
        F.sum(tokens).alias("tokens_used"),
        _first(text, visible & user & ~generated(text)).alias("first_user_message"),
        _last(given("customTitle", "title"), kind == "custom-title").alias("t1"),
        _last(given("hookSpecificOutput.sessionTitle", "sessionTitle")).alias("t2"),
        _last(given("aiTitle", "title"), kind == "ai-title").alias("t3"),
        _last(given("summary"), kind == "summary").alias("t4"),
        _last(given("lastPrompt"), kind == "last-prompt").alias("t5"),
        _last(text, visible).alias("t6"),
    )
    base = F.regexp_extract("cwd", r"([^/\\]+)[/\\]*$", 1)
    title = F.coalesce("t1", "t2", "t3", "t4", "first_user_message", "t5", "t6", F.when(base != "", base), "id")
    return found.select(F.lit("claude").alias("provider"), "path", "id", "cwd", "model", "created_at", "updated_at", "tokens_used", F.coalesce("first_user_message", F.lit("")).alias("first_user_message"), cut(title, 160).alias("title"))


def qoder_summaries(rows: DataFrame) -> DataFrame:
    """As claude_summaries, of logs that lie right in their project's folder (read them with ``jsonl.lines(..., deep=False)``)."""
    return claude_summaries(rows).withColumn("provider", F.lit("qoder")).withColumn("source", F.lit("cli"))


def qoder_events(rows: DataFrame) -> DataFrame:
    """(path, line_no, at, role, kind, text) as claude_events, side chains as meta; blocks of kinds that aren't known say nothing."""
    return claude_events(rows, side_chains=False)


def workbuddy_events(rows: DataFrame) -> DataFrame:
    """(path, line_no, at, role, text): messages; of a user's text only the last query between its marks."""
    role = F.coalesce(text_at("$.role"), F.lit(""))
    blocks = F.try_variant_get("json", "$.content", "array<variant>")
    want = F.when(role == "user", "input_text").when(role == "assistant", "output_text").otherwise("")
    fine = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == want)
    text = F.coalesce(F.array_join(F.transform(fine, lambda b: F.try_variant_get(b, "$.text", "string")), "\n\n"), F.lit(""))
    query = F.trim(F.regexp_extract(text, r"(?s).*<user_query>(.*?)</user_query>", 1))
    mine = F.when(role != "user", text).when(F.ltrim(text).startswith("<cb_summary>"), "").otherwise(query)
    shown = (F.coalesce(text_at("$.type"), F.lit("")) == "message") & role.isin("user", "assistant") & (mine != "")
    return rows.select("path", "line_no", seconds_at("$.timestamp").alias("at"), F.when(shown, role).otherwise("meta").alias("role"), F.when(shown, mine).otherwise("").alias("text"))


def grok_events(rows: DataFrame) -> DataFrame:
    """(path, line_no, role, kind, text): updates after rewinds, adjacent chunks of one kind and prompt joined.

    A row belongs to the prompt before it; a rewind to prompt n takes back all
    earlier rows of prompts n and later, so a row stays if no later rewind goes
    to its prompt or before. A tool call is one event, told by its last title.
    """
    u = "$.params.update"
    kind = F.coalesce(text_at(f"{u}.sessionUpdate"), F.lit(""))
    extension = F.coalesce(text_at("$.method"), F.lit("")) == "_x.ai/session/update"
    target = F.when(extension & (kind == "rewind_marker"), long_at(f"{u}.target_prompt_index"))
    prompt = F.when((kind == "user_message_chunk") & ~extension & ~flag_at(f"{u}._meta.hostTurn"), long_at(f"{u}._meta.promptIndex"))
    in_file = W.partitionBy("path").orderBy("line_no")
    told = rows.select("path", "line_no", kind.alias("kind"), extension.alias("extension"), target.alias("target"), prompt.alias("prompt"), text_at(f"{u}.content.text").alias("text"), text_at(f"{u}.toolCallId").alias("call"), text_at(f"{u}.title").alias("title"), flag_at(f"{u}._meta.hostTurn").alias("host"))
    at = told.withColumn("at", F.last(F.coalesce("prompt", F.col("target") - 1), True).over(in_file))
    later = F.min("target").over(W.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1))
    alive = at.withColumn("later", later).where("target is null and (later is null or coalesce(at, -1) < later)")
    chunk = F.col("kind").isin("user_message_chunk", "agent_message_chunk", "agent_thought_chunk") & ~F.col("extension") & ~F.col("host") & F.col("text").isNotNull()
    key = F.when(chunk, F.concat_ws("|", "kind", F.coalesce(F.col("prompt").cast("string"), F.lit(""))))
    marked = alive.withColumn("key", key)
    new = (~F.col("key").eqNullSafe(F.lag("key").over(in_file))).cast("int")
    grouped = marked.withColumn("new", new).withColumn("island", F.sum("new").over(in_file))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "")
    said = grouped.where("key is not null").groupBy("path", "island", "kind").agg(F.min("line_no").alias("line_no"), joined.alias("text"))
    role = F.when(F.col("kind") == "user_message_chunk", "user").when(F.col("kind") == "agent_thought_chunk", "reasoning").otherwise("assistant")
    tools = alive.where(F.col("kind").isin("tool_call", "tool_call_update") & F.col("call").isNotNull() & ~F.col("extension")).groupBy("path", "call").agg(F.coalesce(_last(F.col("title")), F.lit("tool")).alias("text"), F.min("line_no").alias("line_no"))
    return said.select("path", "line_no", role.alias("role"), "kind", "text").unionByName(tools.select("path", "line_no", F.lit("tool_call").alias("role"), F.lit("tool_call").alias("kind"), "text"))


def _active(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """(path, id, depth) from the tips up; nodes have path, id and parent, tips path and id."""
    key = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat_ws("\u0001", "path", c))
    way = graph.active_path(nodes.select(key("id").alias("id"), key("parent").alias("parent")), tips.select(key("id").alias("id")))
    part = F.split("id", "\u0001")
    return way.select(part[0].alias("path"), part[1].alias("id"), "depth")


# System rows that hold a program's own state.
STATE_ROWS = (
    "session_artifact_event", "session_artifact_snapshot", "session_sources_snapshot",
    "managed_session_header_v1", "managed_session_event_v1", "managed_session_commit_v1",
)


def _qwen(rows: DataFrame) -> DataFrame:
    """Rows of messages: id, parent and parts; a program's own state is left out."""
    r = rows.select("path", "line_no", text_at("$.uuid").alias("id"), text_at("$.parentUuid").alias("parent"), text_at("$.type").alias("type"), text_at("$.subtype").alias("subtype"), F.try_variant_get("json", "$.message.parts", "array<variant>").alias("parts"))
    skip = F.coalesce((F.col("type") == "system") & F.col("subtype").isin(*STATE_ROWS), F.lit(False))
    return r.where(~skip & F.col("id").isNotNull())


def qwen_problems(rows: DataFrame) -> DataFrame:
    """(path, problem) of logs whose way up from the last row ends at an id that isn't there, or never.

    Rows beside the way may hang on anything; a log without problems isn't listed.
    """
    r = _qwen(rows)
    key = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat_ws("\u0001", "path", c))
    nodes = r.groupBy(key("id").alias("id")).agg(F.min_by(key("parent"), "line_no").alias("parent")).where("id is not null")
    tips = r.groupBy("path").agg(F.max_by("id", "line_no").alias("id")).select(key("id").alias("id")).where("id is not null")
    way = graph.ancestors(nodes, tips)
    lost = way.join(nodes, "id", "left_anti").select("id", F.lit("missing parent").alias("problem"))
    ring = graph.on_cycles(nodes.join(way.select("id"), "id", "left_semi")).withColumn("problem", F.lit("cycle"))
    return lost.unionByName(ring).select(F.split("id", "\u0001")[0].alias("path"), "problem").distinct()


def qwen_events(rows: DataFrame) -> DataFrame:
    """(path, place, id, role, text): the way from the root to the last row, fragments of an id merged in their order."""
    r = _qwen(rows)
    text = F.filter(F.transform("parts", lambda p: F.when(~F.coalesce(F.try_variant_get(p, "$.thought", "boolean"), F.lit(False)), F.try_variant_get(p, "$.text", "string"))), lambda t: t.isNotNull() & ~F.ltrim(t).startswith("<qwen:user-prompt-submit-context>"))
    told = r.withColumn("text", F.array_join(text, ""))
    merged = told.groupBy("path", "id").agg(F.min_by("parent", "line_no").alias("parent"), F.min_by("type", "line_no").alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("text"))
    tips = r.groupBy("path").agg(F.max_by("id", "line_no").alias("id"))
    way = _active(merged, tips)
    role = F.when(F.col("type") == "system", "meta").when(F.col("type") == "tool_result", "tool_result").otherwise(F.col("type"))
    return merged.join(way, ["path", "id"]).select("path", F.row_number().over(W.partitionBy("path").orderBy(F.desc("depth"))).alias("place"), "id", role.alias("role"), "text")


def pi_events(rows: DataFrame) -> DataFrame:
    """(path, line_no, role, text): entries on the active path, which ends at the last entry."""
    r = rows.select("path", "line_no", text_at("$.id").alias("id"), text_at("$.parentId").alias("parent"), text_at("$.type").alias("type"), F.coalesce(text_at("$.message.role"), F.lit("")).alias("role"), content_text("$.message.content").alias("text")).where("id is not null and type <> 'session'")
    way = _active(r, r.groupBy("path").agg(F.max_by("id", "line_no").alias("id")))
    shown = (F.col("type") == "message") & F.col("role").isin("user", "assistant")
    return r.join(way.select("path", "id"), ["path", "id"], "left_semi").select("path", "line_no", F.when(shown, F.col("role")).otherwise("meta").alias("role"), F.when(shown, F.col("text")).otherwise("").alias("text"))


def dsh_events(rows: DataFrame) -> DataFrame:
    """(path, seq, at, role, text, whole): messages of the file of highest version in a folder; whole tells whether seq has no gap."""
    version = F.coalesce(F.max(F.when(text_at("$.type") == "session", long_at("$.version"))).over(W.partitionBy("path")), F.lit(0))
    folder = F.regexp_extract("path", r"^(.*)[/\\]", 1)
    live = rows.withColumn("version", version).withColumn("best", F.max(F.struct("version", "path")).over(W.partitionBy(folder))).where("path = best.path")
    e = live.select("path", "line_no", long_at("$.seq").alias("seq"), long_at("$.time").alias("ms"), text_at("$.type").alias("type"), F.when(text_at("$.type") == "user/message", content_text("$.data.content")).otherwise(content_text("$.data.message.content")).alias("text")).where("seq is not null")
    e = e.withColumn("right", F.col("seq") == F.row_number().over(W.partitionBy("path").orderBy("line_no")) - 1)
    role = F.when(F.col("type") == "user/message", "user").when(F.col("type") == "assistant/message", "assistant").when(F.col("type") == "tool/result", "tool_result").otherwise("meta")
    return e.select("path", "seq", F.floor(F.col("ms") / 1000).alias("at"), role.alias("role"), "text", F.min("right").over(W.partitionBy("path")).alias("whole"))


@F.pandas_udf(T.StringType())
def unzstd(data: pd.Series) -> pd.Series:
    """Text of zstandard frames; null for what is none."""

    def one(raw: bytes | None) -> str | None:
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw).decode("utf-8", "replace") if raw is not None else None
        except zstandard.ZstdError:
            return None

    return data.map(one)


def zstd_lines(spark: SparkSession, path: str, glob: str = "*.zst*") -> DataFrame:
    """As jsonl.lines, of compressed files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    each = files.select("path", F.split(unzstd("content"), "\r?\n").alias("each"))
    return each.select("path", F.posexplode("each").alias("line_no", "value")).where(F.trim("value") != "")


def copilot_events(rows: DataFrame) -> DataFrame:
    """(path, line_no, id, role, text): the first of repeated ids and of repeated tool calls; rows of hidden agents are meta."""
    kind = text_at("$.type")
    r = rows.select("path", "line_no", text_at("$.id").alias("id"), kind.alias("type"), text_at("$.data.toolCallId").alias("call"), text_at("$.data.parentAgentTaskId").alias("hidden"), F.coalesce(text_at("$.data.content"), text_at("$.data.toolName"), F.lit("")).alias("text"))
    name = F.coalesce(F.concat(F.lit("call:"), "type", F.lit(":"), "call"), F.concat(F.lit("id:"), "id"), F.concat(F.lit("line:"), "line_no"))
    first = r.withColumn("nth", F.row_number().over(W.partitionBy("path", name).orderBy("line_no"))).where("nth = 1")
    role = F.when(F.col("hidden").isNotNull(), "meta").when(F.col("type") == "user.message", "user").when(F.col("type") == "assistant.message", "assistant").when(F.col("type") == "tool.execution_start", "tool_call").when(F.col("type") == "tool.execution_complete", "tool_result").otherwise("meta")
    return first.select("path", "line_no", "id", role.alias("role"), "text")


def copilot_problems(rows: DataFrame) -> DataFrame:
    """(path, line_no, problem): the first that each bad line of a log has; json may be null.

    A parent that isn't there is none, as a program cuts its logs; an event that
    names itself is.
    """
    kind = lambda p: F.schema_of_variant(F.try_variant_get("json", p, "variant"))
    begins = (text_at("$.type") == "session.start") & (long_at("$.data.version") == 1)
    r = rows.withColumn("id", text_at("$.id")).withColumn("nth", F.row_number().over(W.partitionBy("path", "id").orderBy("line_no")))
    head = rows.groupBy("path").agg(F.min("line_no").alias("head"))
    r = r.join(head, "path")
    first = F.col("line_no") == F.col("head")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problem = (
        F.when(F.col("json").isNull(), "not JSON")
        .when(no(F.col("id") != ""), "empty id")
        .when(no(text_at("$.type") != "") | no(kind("$.data").startswith("OBJECT")) | no(seconds_at("$.timestamp") != 0), "bad event")
        .when(F.col("nth") > 1, "repeated id")
        .when(text_at("$.parentId") == F.col("id"), "own parent")
        .when(first & no(begins), "bad start")
        .when(~first & (text_at("$.type") == "session.start"), "second start")
    )
    return r.select("path", "line_no", problem.alias("problem")).where("problem is not null")


def antigravity_events(rows: DataFrame) -> DataFrame:
    """(path, idx, at, role, text, cut): steps; a user's text is what its request marks hold; cut tells of fields left out."""
    kind, source = text_at("$.type"), text_at("$.source")
    text = F.coalesce(text_at("$.content"), F.lit(""))
    asked = F.trim(F.regexp_extract(text, r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1))
    role = F.when(kind == "USER_INPUT", "user").when((kind == "PLANNER_RESPONSE") & (text != ""), "assistant").when(kind == "PLANNER_RESPONSE", "tool_call").when(source == "SYSTEM", "meta").otherwise("tool_result")
    fields = F.coalesce(F.try_variant_get("json", "$.truncated_fields", "array<string>"), F.array().cast("array<string>"))
    return rows.select("path", long_at("$.step_index").alias("idx"), seconds_at("$.created_at").alias("at"), role.alias("role"), F.when((kind == "USER_INPUT") & (asked != ""), asked).otherwise(text).alias("text"), F.array_contains(fields, "content").alias("cut"))


def cline_events(messages: DataFrame, manifests: DataFrame) -> DataFrame:
    """(session, message, block, role, kind, text, cwd): one row a block, with its manifest's directory.

    Both have the column json with a whole document.
    """
    m = messages.select(text_at("$.sessionId").alias("session"), F.posexplode(F.try_variant_get("json", "$.messages", "array<variant>")).alias("message", "m"))
    b = m.select("session", "message", F.try_variant_get("m", "$.role", "string").alias("role"), F.posexplode(F.try_variant_get("m", "$.content", "array<variant>")).alias("block", "b"))
    kind = F.try_variant_get("b", "$.type", "string")
    role = F.when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result").when(kind == "thinking", "reasoning").otherwise(F.col("role"))
    text = F.coalesce(F.try_variant_get("b", "$.text", "string"), F.try_variant_get("b", "$.thinking", "string"), F.try_variant_get("b", "$.name", "string"), F.lit(""))
    cwd = manifests.select(F.coalesce(text_at("$.session_id"), text_at("$.sessionId")).alias("session"), text_at("$.cwd").alias("cwd"))
    return b.join(cwd, "session", "left").select("session", "message", "block", role.alias("role"), kind.alias("kind"), text.alias("text"), "cwd")


def codex_briefs(rows: DataFrame) -> DataFrame:
    """One row a file: the first identity, first and last time, the last counter and the first user text in 200 characters."""
    kind, inner = F.coalesce(text_at("$.type"), F.lit("")), F.coalesce(text_at("$.payload.type"), F.lit(""))
    meta, at = kind == "session_meta", seconds_at("$.timestamp")
    said = F.coalesce(text_at("$.payload.message"), F.lit(""))
    return rows.groupBy("path").agg(
        _first(text_at("$.payload.id"), meta).alias("id"),
        _first(text_at("$.payload.cwd"), meta).alias("cwd"),
        F.coalesce(_first(text_at("$.payload.model_provider"), meta), F.lit("openai")).alias("model_provider"),
        F.min_by(at, F.when(at.isNotNull(), F.col("line_no"))).alias("created_at"),
        F.max(at).alias("updated_at"),
        F.coalesce(_last(long_at("$.payload.info.total_token_usage.total_tokens"), (kind == "event_msg") & (inner == "token_count")), F.lit(0)).alias("tokens_used"),
        F.coalesce(F.substring(_first(F.trim(said), (kind == "event_msg") & (inner == "user_message") & (F.trim(said) != "")), 1, 200), F.lit("")).alias("first_user_message"),
    )


def supplement(sessions: DataFrame, archived: DataFrame) -> DataFrame:
    """Sessions, and archived files that neither their name nor their id has among them."""
    name = lambda df: df.withColumn("_name", _name(F.col("path")))
    new = name(archived).join(name(sessions).select("_name").distinct(), "_name", "left_anti").join(sessions.select("id").distinct(), "id", "left_anti").drop("_name")
    return sessions.unionByName(new.withColumn("archived", F.lit(True)), allowMissingColumns=True)


def history_ids(rows: DataFrame) -> DataFrame:
    """(path, line_no, session): the first of three names that isn't blank."""
    names = [F.trim(text_at(f"$.{n}")) for n in ("sessionId", "session_id", "id")]
    return rows.select("path", "line_no", F.coalesce(*[F.when(n != "", n) for n in names]).alias("session"))


def memory_projects(spark: SparkSession, path: str) -> DataFrame:
    """(project, files, bytes, updated_at, has_index) of folders of Markdown notes; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path).select("path", "length", "modificationTime")
    project = F.regexp_extract("path", r"([^/]+)/(?:memory/)?[^/]+$", 1)
    return files.groupBy(project.alias("project")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("updated_at"), F.max(F.col("path").endswith("/MEMORY.md")).alias("has_index"))


def numstat(rows: DataFrame, by: str = "path") -> DataFrame:
    """(by, files, added, deleted, names) of lines added TAB deleted TAB name; binary files count no lines."""
    part = F.split("value", "\t", 3)
    each = rows.select(by, part[0].try_cast("long").alias("added"), part[1].try_cast("long").alias("deleted"), part[2].alias("name")).where("name is not null")
    return each.groupBy(by).agg(F.countDistinct("name").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"), F.array_sort(F.collect_set("name")).alias("names"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def child_blobs(data: pd.Series) -> pd.Series:
    """Hexadecimal ids of 32 bytes in the first field of a length-delimited message."""

    def one(raw: bytes | None) -> list[str]:
        found, at = [], 0
        while raw and at < len(raw):
            tag, at = _varint(raw, at)
            kind = tag & 7
            if kind == 2:
                size, at = _varint(raw, at)
                if tag >> 3 == 1 and size == 32 and at + 32 <= len(raw):
                    found.append(raw[at : at + 32].hex())
                at += size
            elif kind == 0:
                _, at = _varint(raw, at)
            else:
                at += {1: 8, 5: 4}.get(kind, len(raw))
        return found

    return data.map(one)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n, shift = 0, 0
    while at < len(raw):
        b = raw[at]
        n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            break
    return n, at


def reachable_blobs(blobs: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of blobs (id in hexadecimal, data) that the roots reach; others are orphans by an anti-join."""
    edges = blobs.select(F.col("id").alias("parent"), F.explode(child_blobs("data")).alias("id"))
    return graph.descendants(edges, roots).join(blobs.select("id"), "id", "left_semi")


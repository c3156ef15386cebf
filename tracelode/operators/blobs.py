"""Content-addressed stores: what is still referred to, and what may go.

A store has key (string) and value (binary). Blobs and contents are named by a
digest of 32 bytes; states hold digests of blobs as raw bytes at any offset,
whatever the encoding around them, contents are named in hexadecimal. So a
reference is any window of 32 bytes that is a known digest: that may keep a row
too many, never one too few, and a row that can't be read vetoes all deletions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import batches_of, cut_lineage
from ..sources.jsonl import text_at
from . import graph

# Names of the rows of a store.
BLOB, CONTENT = "agentKv:blob:", "composer.content."
POINTERS = ("agentKv:checkpoint:", "agentKv:bubbleCheckpoint:")
STATES = ("composerData:", "bubbleId:")

#: Bits of the filter that windows pass before they are rows: at most 16 MB, whatever the number of digests.
LEAST_BITS, MOST_BITS = 16, 27
#: Windows tried at once in a task, and rows that it is handed at once: what passes the filter is a share of their bytes.
STRIDE, HANDED = 1 << 20, 256
BLANKS = " \t\r\n"


def named(store: DataFrame, prefix: str) -> DataFrame:
    """(id, key, bytes) of the rows whose key is the prefix and 64 hexadecimal digits; a null value has no bytes."""
    digits = F.substring("key", len(prefix) + 1, 1_000)
    rows = store.where(F.col("key").startswith(prefix) & digits.rlike("^[0-9a-fA-F]{64}$"))
    return rows.select(F.lower(digits).alias("id"), "key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("bytes"))


def from_base64(text: Column) -> Column:
    """Bytes of a text in either alphabet of base 64, after a tilde or not; null for other texts."""
    body = F.regexp_replace(text, "^~", "")
    one = F.when(body.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z"), body).when(body.rlike(r"\A[A-Za-z0-9_-]*={0,2}\z"), F.translate(body, "-_", "+/"))
    raw = F.try_to_binary(one, F.lit("base64"))
    return F.when(F.base64(raw) == one, raw)


def _starts(key: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found |= key.startswith(p)
    return found


def _readings(store: DataFrame) -> DataFrame:
    """(key, pointer, state, broken): what a row other than a blob refers to blobs with, decoded."""
    rows = store.where(F.col("key").isNotNull() & F.col("value").isNotNull() & _starts(F.col("key"), POINTERS + STATES))
    text = F.try_validate_utf8("value")
    rows = rows.select("key", text.alias("text"), F.when(_starts(F.col("key"), POINTERS), "pointer").otherwise("state").alias("kind"))
    rows = rows.withColumn("json", F.when(F.col("kind") == "state", F.try_parse_json("text")))
    body = F.when(F.col("kind") == "pointer", F.trim("text", F.lit(BLANKS))).otherwise(text_at("$.conversationState"))
    rows = rows.select("key", "kind", body.alias("body")).where((F.col("kind") == "pointer") & F.col("body").isNotNull() | (F.col("body") != ""))
    rows = rows.withColumn("raw", from_base64(F.col("body")))
    bad = F.col("raw").isNull() | (F.col("kind") == "pointer") & (F.octet_length("raw") != 32)
    return rows.select("key", F.when(~bad, F.col("raw")).alias("raw"), bad.alias("broken"))


def _bits(ids: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A bitmap over the first bits of the digests, built by Spark in words of 64 bits and of bounded size."""
    bits = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + 5))
    slot = F.shiftright(F.conv(F.substring("id", 1, 8), 16, 10).cast("long"), 32 - bits)
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bits, table


def windows_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, id): each known digest that stands at any offset in the bytes of a row (key, raw), once a row.

    ids has id, 64 lower hexadecimal digits. Windows go through a bitmap of the
    digests' first bits in the task that holds the row; only what passes becomes
    a row and meets the digests in a join. Null and short bytes have no window.
    """
    ids = ids.select("id").distinct()
    bits, table = _bits(ids, ids.count())
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def tried(raw: bytes) -> set[bytes]:
        b, found = np.frombuffer(raw, np.uint8), set()
        for at in range(0, len(b) - 31, STRIDE):
            part = b[at : at + STRIDE + 3].astype(np.uint32)
            n = min(STRIDE, len(b) - 31 - at)
            slot = (part[:n] << 24 | part[1 : n + 1] << 16 | part[2 : n + 2] << 8 | part[3 : n + 3]) >> np.uint32(32 - bits)
            hit = (shared.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            found.update(raw[at + i : at + i + 32] for i in np.flatnonzero(hit).tolist())
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, raw in zip(batch.column("key"), batch.column("raw"), strict=True):
                hits = tried(raw.as_py()) if raw.is_valid else ()
                keys += [key.as_py()] * len(hits)
                found += hits
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "window": pa.array(found, pa.binary())})

    seen = rows.select("key", "raw").mapInArrow(scan, "key string, window binary")
    return seen.select("key", F.lower(F.hex("window")).alias("id")).join(ids, "id", "left_semi").select("key", "id")


def live(store: DataFrame) -> DataFrame:
    """(id, depth): blobs that a pointer or state names, directly or through other blobs."""
    blobs = named(store, BLOB)
    raw = store.join(blobs.select("key", F.col("id").alias("_id")), "key").select(F.col("_id").alias("key"), F.col("value").alias("raw"))
    with batches_of(store.sparkSession, HANDED):
        edges = cut_lineage(windows_among(raw, blobs).select(F.col("key").alias("parent"), "id").distinct())
        roots = cut_lineage(windows_among(_readings(store).select("key", "raw"), blobs).select("id").distinct())
    return graph.descendants(edges, roots)


def content_refs(store: DataFrame) -> DataFrame:
    """(key, id) of contents that rows other than blobs name in hexadecimal anywhere in their value."""
    text = F.decode("value", "ISO-8859-1")
    refs = store.where(~F.col("key").startswith(BLOB)).select("key", F.explode(F.regexp_extract_all(text, F.lit(r"composer\.content\.([0-9a-fA-F]{64})"), F.lit(1))).alias("id"))
    return refs.select("key", F.lower("id").alias("id")).distinct()


def unreadable(store: DataFrame, reached: DataFrame) -> DataFrame:
    """(key, problem): pointers and states that can't be decoded, and reached blobs without a value."""
    empty = store.where(F.col("value").isNull()).join(named(store, BLOB).join(reached.select("id"), "id", "left_semi").select("key"), "key", "left_semi")
    return _readings(store).where("broken").select("key", F.lit("reference").alias("problem")).unionByName(empty.select("key", F.lit("value").alias("problem")))


def sweep(store: DataFrame) -> DataFrame:
    """(key, kind, bytes, live, deletable) of every blob and content.

    A row may be deleted if nothing refers to it and every reference in the
    store could be read: a single one that can't keeps all. Rows without key,
    with other keys or with digests of another length take no part; a key that
    comes twice is listed twice.
    """
    reached = cut_lineage(live(store))
    veto = not unreadable(store, reached).isEmpty()
    both = [
        named(store, BLOB).join(reached.select("id", F.lit(True).alias("live")), "id", "left").withColumn("kind", F.lit("blob")),
        named(store, CONTENT).join(content_refs(store).select("id", F.lit(True).alias("live")).distinct(), "id", "left").withColumn("kind", F.lit("content")),
    ]
    rows = both[0].unionByName(both[1]).withColumn("live", F.coalesce("live", F.lit(False)))
    return rows.select("key", "kind", "bytes", "live", (~F.col("live") & F.lit(not veto)).alias("deletable"))


def chat_events(blobs: DataFrame, heads: DataFrame, children: Column) -> DataFrame:
    """(session, message, part, role, text, call, blob): a chat in the order that its root lists its messages.

    blobs have session, id and data, a message in JSON or a list of messages;
    heads have session and root. children gives a list's ids from the column
    data. Blocks of text side by side are one event, a call or a result is one
    of its own; context that a program put into a user's message and system
    prompts are meta. Ids that lead nowhere and data that isn't JSON are left out.
    """
    root = heads.where("root is not null").join(blobs.withColumnRenamed("id", "root"), ["session", "root"])
    listed = root.select("session", F.posexplode(children).alias("message", "id"))
    text = F.try_validate_utf8("data")
    read = listed.join(blobs, ["session", "id"]).withColumn("json", F.try_parse_json(text)).where("json is not null")
    content = F.try_variant_get("json", "$.content", "variant")
    blocks = F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get("json", "$.content", "array<variant>"))
    rows = read.select("session", "message", F.col("id").alias("blob"), F.coalesce(text_at("$.role"), F.lit("")).alias("role"), F.coalesce(text_at("$.content"), F.lit("")).alias("plain"), blocks.alias("blocks"))
    whole = (F.col("role") == "system") | F.col("blocks").isNull()
    meta = (F.col("role") == "system") | (F.col("role") == "user") & injected(F.col("plain"))
    single = rows.where(whole).select("session", "message", F.lit(0).alias("at"), F.when(meta, 1).otherwise(2).alias("rank"), F.lit(0).alias("b"), F.when(meta, "meta").otherwise(F.col("role")).alias("role"), F.when(meta, F.col("plain")).otherwise(asked(F.col("plain"))).alias("text"), F.lit(None).cast("string").alias("call"), "blob")

    each = rows.where(~whole).select("session", "message", "blob", "role", F.posexplode("blocks").alias("b", "json"))
    said, kind = F.coalesce(text_at("$.text"), F.lit("")), F.coalesce(text_at("$.type"), F.lit(""))
    result = F.try_variant_get("json", "$.result", "variant")
    told = F.coalesce(text_at("$.result"), F.when(F.schema_of_variant(result) != "VOID", F.to_json(result)), F.lit(""))
    each = each.select("session", "message", "blob", "b", "role", kind.alias("kind"), said.alias("said"), text_at("$.toolCallId").alias("call"), F.coalesce(text_at("$.toolName"), F.lit("")).alias("tool"), told.alias("told"))
    each = each.where(F.col("kind").isin("text", "tool-call", "tool-result"))
    # texts are given out before the call or result that ends them, injected context before the texts around it
    ended = F.sum((F.col("kind") != "text").cast("int")).over(W.partitionBy("session", "message").orderBy("b"))
    each = each.withColumn("at", ended.cast("int"))
    hidden = (F.col("role") == "user") & injected(F.col("said"))
    acts = each.where(F.col("kind") != "text").select("session", "message", "at", F.lit(0).alias("rank"), "b", F.when(F.col("kind") == "tool-call", "tool_call").otherwise("tool_result").alias("role"), F.when(F.col("kind") == "tool-call", F.col("tool")).otherwise(F.col("told")).alias("text"), "call", "blob")
    context = each.where((F.col("kind") == "text") & hidden).select("session", "message", "at", F.lit(1).alias("rank"), "b", F.lit("meta").alias("role"), F.lit("").alias("text"), F.lit(None).cast("string").alias("call"), "blob")
    pieces = F.array_sort(F.collect_list(F.struct("b", asked(F.col("said")).alias("t"))))
    texts = each.where((F.col("kind") == "text") & ~hidden).groupBy("session", "message", "at", "role", "blob").agg(F.min("b").alias("b"), F.array_join(F.transform(pieces, lambda x: x["t"]), "\n\n").alias("text"))
    texts = texts.select("session", "message", "at", F.lit(2).alias("rank"), "b", "role", "text", F.lit(None).cast("string").alias("call"), "blob")
    every = single.unionByName(acts).unionByName(context).unionByName(texts)
    # a message's events are numbered within it; a chat is never in one window
    nth = F.array_sort(F.collect_list(F.struct("at", "rank", "b", "role", "text", "call", "blob")))
    return every.groupBy("session", "message").agg(nth.alias("of")).select("session", "message", F.posexplode("of").alias("part", "e")).select("session", "message", "part", "e.role", "e.text", "e.call", "e.blob")


def injected(text: Column) -> Column:
    """Whether a text is context that a program put before a user's words."""
    begin = F.ltrim(text, F.lit(BLANKS))
    # How such context begins.
    return ~F.contains(text, F.lit("<user_query>")) & _starts(begin, ("<user_info>", "<environment_context>", "<additional_data>"))


def asked(text: Column) -> Column:
    """What stands in the tags of a user's query; other texts as they are."""
    inner = F.trim(F.regexp_extract(text, r"(?s)\A\s*<user_query>(.*)</user_query>\s*\z", 1), F.lit(BLANKS))
    return F.when(inner != "", inner).otherwise(text)

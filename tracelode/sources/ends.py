"""The first or last line of a kind in each log, read from that end only.

Files are listed by Spark without their contents; tasks then read blocks from
one end until the line is found, so a log of gigabytes costs a block or two.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundles import opened

BLOCK = 1 << 16


def files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, length) of files below a folder; Spark leaves files of no bytes out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def _forward(f, size: int, block: int) -> Iterator[bytes]:
    kept: list[bytes] = []
    for at in range(0, size, block):
        head, *rest = f.read_at(min(block, size - at), at).split(b"\n")
        kept.append(head)
        for line in rest:
            yield b"".join(kept)
            kept = [line]
    yield b"".join(kept)


def _backward(f, size: int, block: int) -> Iterator[bytes]:
    kept: list[bytes] = []
    at = size
    while at > 0:
        first = max(0, at - block)
        *rest, tail = f.read_at(at - first, first).split(b"\n")
        kept.append(tail)
        for line in reversed(rest):
            yield b"".join(reversed(kept))
            kept = [line]
        at = first
    yield b"".join(reversed(kept))


def end_lines(listed: DataFrame, mark: bytes, pick: Callable[[object], str | None], last: bool = True, block: int = BLOCK) -> DataFrame:
    """(path, value, bytes_read): what pick makes of the last (or first) line of each file that it doesn't refuse by None; null if it refuses all.

    Only lines of JSON that hold the mark, or an escape that could spell it, are
    parsed. A line longer than a block is put together from several; bad lines
    are passed over. bytes_read says how much of the file was read.
    """

    def tried(line: bytes) -> str | None:
        if mark in line or b"\\u" in line:
            try:
                return pick(json.loads(line))
            except (ValueError, RecursionError):
                pass
        return None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, values, reads = batch.column("path").to_pylist(), [], []
            for path in paths:
                where, name = opened(path)
                size = where.get_file_info(name).size or 0
                with where.open_input_file(name) as raw:
                    f = _Counted(raw)
                    values.append(next((v for x in (_backward if last else _forward)(f, size, block) if (v := tried(x)) is not None), None))
                reads.append(f.read)
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "value": pa.array(values, pa.string()), "bytes_read": pa.array(reads, pa.int64())})

    return listed.select("path").repartition("path").mapInArrow(find, "path string, value string, bytes_read long")


class _Counted:
    def __init__(self, f) -> None:
        self.f, self.read = f, 0

    def read_at(self, n: int, at: int) -> bytes:
        self.read += n
        return self.f.read_at(n, at)


#: Places of a token counter's total, the first that holds a whole number of 0 or more counts. Fixed values.
TOTALS = ("payload.info.total_token_usage.total_tokens", "payload.info.total_tokens", "payload.total_tokens", "total_tokens")


def _at(row: object, path: str) -> object:
    for name in path.split("."):
        row = row.get(name) if isinstance(row, dict) else None
    return row


def _total(row: object) -> str | None:
    if _at(row, "type") != "event_msg" or _at(row, "payload.type") != "token_count":
        return None
    return next((str(n) for p in TOTALS if type(n := _at(row, p)) is int and 0 <= n < 1 << 63), None)


def _identity(row: object) -> str | None:
    found = _at(row, "payload.id") if _at(row, "type") == "session_meta" else None
    if not isinstance(found, str) or not found.strip():
        return None
    provider, source = _at(row, "payload.model_provider"), _at(row, "payload.source")
    return json.dumps({"id": found.strip(), "model_provider": provider if isinstance(provider, str) else "openai", "source": source if isinstance(source, str) else None})


def token_totals(spark: SparkSession, path: str, glob: str = "*.jsonl", block: int = BLOCK) -> DataFrame:
    """(path, total, bytes_read): the last token counter of each log, 0 where there is none."""
    found = end_lines(files(spark, path, glob), b"token_count", _total, True, block)
    return found.select("path", F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("total"), "bytes_read")


def identities(spark: SparkSession, path: str, glob: str = "*.jsonl", block: int = BLOCK) -> DataFrame:
    """(path, id, model_provider, source, bytes_read): the first session_meta with an id of each log; a log without one isn't listed."""
    found = end_lines(files(spark, path, glob), b"session_meta", _identity, False, block).where("value is not null")
    return found.withColumn("r", F.from_json("value", "id string, model_provider string, source string")).select("path", "r.*", "bytes_read")

"""Logs as they grow: a source that follows appended lines, and stateful operators over streams."""

from __future__ import annotations

import contextlib
import glob
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


@dataclass(frozen=True)
class Cursor:
    """How far a file was read: its identity, size, time, offset of complete lines and a digest of what was read."""

    identity: str | None
    size: int
    mtime_ns: int
    offset: int
    digest: str
    version: str = "1"


def decide(cursor: Cursor, identity: str | None, size: int, mtime_ns: int, digest: str | None, version: str = "1") -> tuple[str, str | None]:
    """unchanged, resume or full with the reason; digest is that of the bytes the cursor has read, None if unknown."""
    same = digest == cursor.digest
    if cursor.version != version:
        return "full", "parser version changed"
    if cursor.identity is None and identity is None:
        quiet = (size, mtime_ns) == (cursor.size, cursor.mtime_ns) and same
        return ("unchanged", None) if quiet else ("full", "identity unavailable")
    if cursor.identity is None or identity is None:
        return "full", "identity unavailable"
    if cursor.identity != identity:
        return "full", "file replaced"
    if size < cursor.size:
        return "full", "truncated"
    if digest is None:
        return "full", "hash unverified"
    if not same:
        return "full", "content changed"
    if size > cursor.size:
        return "resume", None
    return ("unchanged", None) if mtime_ns == cursor.mtime_ns else ("full", "content changed")


def checked_append(before: Cursor, after: Cursor, digest: str | None) -> None:
    """Raises if a commit isn't a continuation of the one before."""
    what, reason = decide(before, after.identity, after.size, after.mtime_ns, digest, after.version)
    if what == "full":
        raise ValueError(f"the file must be read anew: {reason}")
    if after.offset < before.offset:
        raise ValueError("an offset can't go back")


def prefix_digest(path: str, size: int) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while size and (part := f.read(min(size, 1 << 20))):
            h.update(part)
            size -= len(part)
    return h.hexdigest()


class _Span(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class Records:
    """What tasks tell of the prefixes they have read: a small file for each log and offset in a shared folder.

    A record has the digest of all bytes up to its offset, whether the log was
    resumed, and the digest that the bytes read before had then.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file://")

    def _file(self, path: str, offset: int) -> str:
        return os.path.join(self.folder, f"{hashlib.sha256(path.encode()).hexdigest()[:32]}-{offset}.json")

    def get(self, path: str, offset: int) -> dict | None:
        try:
            with open(self._file(path, offset)) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def put(self, path: str, offset: int, **record) -> None:
        """Written beside and renamed, so that a task that is lost or runs twice leaves a whole record or none."""
        os.makedirs(self.folder, exist_ok=True)
        name = self._file(path, offset)
        with open(f"{name}.{uuid.uuid4().hex}", "w") as f:
            json.dump(record, f)
        os.replace(f.name, name)

    def forget(self, path: str, offset: int) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self._file(path, offset))


class AppendedLines(DataSource):
    """Format ``appended_lines``: rows (path, offset, value) of every complete line of growing files.

    The offset of a stream is a cursor for each file up to its last line break;
    a partial line waits for its end. Spark's own file source never looks at a
    file twice. The driver looks at sizes, times and identities only: a file
    that shrank or was replaced is read anew from its start. A task that is to
    resume a file reads what was read before again, and only if its digest is
    the one recorded then goes on behind it; after any change in between it
    gives all lines anew. ``digests`` names a shared folder for the records.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema):
        return _Follow(self.options)


class _Follow(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.records = options["path"].removeprefix("file://"), Records(options["digests"])
        self.done: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for path in sorted(glob.glob(os.path.join(self.pattern, "*.jsonl") if os.path.isdir(self.pattern) else self.pattern)):
            end = _last_break(path)
            if end:
                about = os.stat(path)
                found[path] = asdict(Cursor(f"{about.st_dev}:{about.st_ino}", end, about.st_mtime_ns, end, ""))
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = []
        for path, now in end.items():
            first = 0
            if path in start:
                before, after = Cursor(**start[path]), Cursor(**now)
                what, _ = decide(before, after.identity, after.size, after.mtime_ns, before.digest, after.version)
                if what == "unchanged":
                    continue
                # A file of the same size that was written to, or one that has grown: a task compares what was read.
                first = before.offset if after.identity == before.identity and after.size >= before.size else 0
            spans.append(_Span(path, first, now["offset"]))
        return spans or [_Span("", 0, 0)]

    def read(self, part: _Span) -> Iterator[tuple]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            seen, left = hashlib.sha256(), part.first
            while left and (block := f.read(min(left, 1 << 20))):
                seen.update(block)
                left -= len(block)
            verified, known = seen.hexdigest(), self.records.get(part.path, part.first)
            resumed = part.first > 0 and known is not None and known["digest"] == verified
            if not resumed:
                f.seek(0)
                seen = hashlib.sha256()
            at = part.first if resumed else 0
            while at < part.last and (line := f.readline(part.last - at)):
                seen.update(line)
                text = line.rstrip(b"\r\n")
                if text.strip():
                    yield part.path, at, text.decode("utf-8", "replace")
                at += len(line)
        # A file written to but left as it was gives nothing and keeps its record.
        if at > part.first or not resumed:
            self.records.put(part.path, at, digest=seen.hexdigest(), resumed=resumed, verified=verified)

    def commit(self, end: dict) -> None:
        """Check that each file's new cursor continues the one before, by the digests that tasks recorded; older records go."""
        for path, now in end.items():
            before, record = self.done.get(path), self.records.get(path, now["offset"])
            if before and record and record["resumed"] and before["offset"] != now["offset"]:
                old = self.records.get(path, before["offset"])
                checked_append(replace(Cursor(**before), digest=old["digest"] if old else ""), Cursor(**now), record["verified"])
                self.records.forget(path, before["offset"])
        self.done = end


def _last_break(path: str, block: int = 1 << 16) -> int:
    """Where the last complete line ends; only the tail is read."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            first = max(0, at - block)
            f.seek(first)
            found = f.read(at - first).rfind(b"\n")
            if found >= 0:
                return first + found + 1
            at = first
    return 0


def follow(spark, path: str, digests: str | None = None) -> DataFrame:
    """A stream of the lines of logs; ``digests`` is a folder that driver and executors share, and that outlives the stream as its checkpoint does."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("digests", digests or f"{shared_folder(spark)}/digests").load(path)


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a key's revisions those that are later than all before; values seen before and earlier ones are refused.

    A key's rows may come in several batches, cut anywhere, so they are put in
    order over all of them, as two columns of numbers.
    """
    last, tokens = state.get if state.exists else (-1, -1)
    out = []
    rows = pd.concat([batch[["at", "tokens"]] for batch in batches]).sort_values(["at", "tokens"])
    for at, n in zip(rows["at"].tolist(), rows["tokens"].tolist(), strict=True):
        late = at <= last
        if not (late and n == tokens):
            out.append((*key, at, n, "late" if late else "kept"))
        if not late:
            last, tokens = at, n
    state.update((last, tokens))
    yield pd.DataFrame(out, columns=["key", "at", "tokens", "what"])


def revisions(rows: DataFrame) -> DataFrame:
    """(key, at, tokens, what) of a stream of (key, at, tokens): kept if later than all before, late if not; replays go."""
    return rows.groupBy("key").applyInPandasWithState(_newest, "key string, at long, tokens long, what string", "at long, tokens long", "append", GroupStateTimeout.NoTimeout)


def _joining(idle_ms: int | None):
    """Runs of a key that a row of another kind has closed, or that nothing followed for a time; lines seen before are passed over."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, first, kind, text = state.get if state.exists else (-1, -1, None, "")
        out, parts = [], [text]
        if state.hasTimedOut:
            # The text is freed; the last line is kept, so that it isn't given again, until the key is idle once more.
            if kind is None:
                state.remove()
            else:
                out.append((*key, first, kind, text))
                state.update((last, -1, None, ""))
                state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame(out, columns=["key", "first", "kind", "text"])
            return
        for row in pd.concat(list(batches)).sort_values("line_no").itertuples():
            if row.line_no <= last:
                continue
            now = row.kind if isinstance(row.kind, str) else None
            if now != kind:
                if kind is not None:
                    out.append((*key, first, kind, "".join(parts)))
                first, kind, parts = int(row.line_no), now, []
            parts.append(row.text if isinstance(row.text, str) else "")
            last = int(row.line_no)
        state.update((last, first, kind, "".join(parts)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "first", "kind", "text"])

    return run


def joined_chunks(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(key, first, kind, text) of a stream of (key, line_no, kind, text): neighbouring chunks of one kind as one text.

    A run is given out once a row of another kind follows, in the same batch or
    a later one, or, with ``idle_ms``, once its key had no row for so long; a chunk
    that comes after that begins a run of its own. A row without a kind closes a
    run and starts none. Lines of a key come in order from batch to batch, as a
    log is appended to. With ``idle_ms`` a key that stays idle for twice as long leaves no state.
    """
    state = "last long, first long, kind string, text string"
    how = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(_joining(idle_ms), "key string, first long, kind string, text string", state, "append", how)


def by_day(rows: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts and tokens by UTC day of a stream or a table; late rows beyond the watermark go."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), "n", "tokens")


def by_week(rows: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """As by_day, by weeks from Monday on."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("w")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), "n", "tokens")


def split_undated(rows: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a time and rows without one, which no window may hold."""
    return rows.where(ts.isNotNull()), rows.where(ts.isNull())

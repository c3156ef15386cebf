"""Sessions as bundles: checked files with a manifest that is written last.

A job writes parts, a file for each session and chunk of its lines, below a folder of its own.
Tasks write under names that no other attempt uses and tell the driver sizes
and digests of what they wrote; the driver adds the manifest on commit, in
parts of bounded size that Spark reads as rows. A folder without a manifest is
no bundle, so a job that fails or is called off leaves none. Paths may be any
that pyarrow opens, and must be the same for driver and executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Version of the layout; older ones have no digests and are never verified.
VERSION = 2
#: Bytes read at once for a digest.
BLOCK = 1 << 20
MANIFEST = "manifest.jsonl"
#: Lines of a session in a file; a longer session has several, in order of chunk.
CHUNK = 100_000
FILES = "session string, chunk long, provider string, updated_at long, file string, bytes long, n_lines long, sha256 string, version int, exported_at long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class _Written(WriterCommitMessage):
    entries: str


class BundleSink(DataSource):
    """Format ``bundle``; rows (session, chunk, provider, updated_at, line), those of a session and chunk side by side and in order; options path and exported_at."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "session string, chunk long, provider string, updated_at long, line string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options["exported_at"]))


class _Writer(DataSourceWriter):
    def __init__(self, path: str, exported_at: int) -> None:
        self.path, self.exported_at, self.job = path.rstrip("/"), exported_at, uuid.uuid4().hex

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        """One file a session and chunk; a list of the files is a file too, so the driver gets a name and no rows."""
        where, root = opened(self.path)
        attempt = uuid.uuid4().hex
        folder = f"{root}/parts/{self.job}-{attempt}"
        out = entry = digest = None
        count = 0
        lists = None

        def end() -> None:
            if out is not None:
                out.close()
                lists.write((json.dumps({**entry, "sha256": digest.hexdigest()}) + "\n").encode())

        for row in iterator:
            if lists is None:
                where.create_dir(folder, recursive=True)
                lists = where.open_output_stream(f"{folder}/files.jsonl")
            key = (row.session, row.chunk)
            if entry is None or key != (entry["session"], entry["chunk"]):
                end()
                file = f"parts/{self.job}-{attempt}/{count}.jsonl"
                out, digest, count = where.open_output_stream(f"{root}/{file}"), hashlib.sha256(), count + 1
                entry = {"session": row.session, "chunk": row.chunk, "provider": row.provider, "updated_at": row.updated_at, "file": file, "bytes": 0, "n_lines": 0, "version": VERSION, "exported_at": self.exported_at}
            data = ((row.line or "") + "\n").encode()
            out.write(data)
            digest.update(data)
            entry["bytes"] += len(data)
            entry["n_lines"] += 1
        end()
        if lists is None:
            return _Written("")
        lists.close()
        return _Written(f"parts/{self.job}-{attempt}")

    def commit(self, messages: list[_Written]) -> None:
        """The manifest: which folders of parts count. Written under another name and moved, so that it is whole or not there."""
        where, root = opened(self.path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{self.job}.tmp") as out:
            for m in messages:
                if m is not None and m.entries:
                    out.write((json.dumps({"part": m.entries, "version": VERSION, "exported_at": self.exported_at}) + "\n").encode())
        where.move(f"{root}/{self.job}.tmp", f"{root}/{MANIFEST}")

    def abort(self, messages: list[_Written]) -> None:
        """Takes away this job's parts, those of lost attempts included; earlier jobs' stay."""
        where, root = opened(self.path)
        for info in where.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)):
            if info.base_name.startswith(self.job):
                where.delete_dir(info.path)


def export_bundle(sessions: DataFrame, lines: DataFrame, path: str, exported_at: int, start: int | None = None, end: int | None = None, active_only: bool = False, chunk: int = CHUNK) -> None:
    """Writes the logs of sessions changed from start to before end as a bundle at path.

    sessions have session, provider, updated_at and archived, lines session,
    line_no and line. A null time lies outside of every range; a session
    without lines has no file. A path that has a manifest is refused. Sessions and
    their chunks are dealt out by hash, so a session of any length is never in
    one task; null line numbers count as 0, a null line is an empty one.
    """
    if start is not None and end is not None and start >= end:
        raise ValueError("a range begins before it ends")
    where, root = opened(path)
    if where.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} is a bundle already")
    if start is not None:
        sessions = sessions.where(F.col("updated_at") >= start)
    if end is not None:
        sessions = sessions.where(F.col("updated_at") < end)
    if active_only:
        sessions = sessions.where(~F.coalesce("archived", F.lit(False)))
    picked = sessions.where("session is not null").groupBy(F.col("session").cast("string").alias("session")).agg(F.max_by(F.struct("provider", F.col("updated_at").cast("long").alias("updated_at")), F.coalesce("updated_at", F.lit(0))).alias("s"))
    rows = lines.select(F.col("session").cast("string").alias("session"), F.coalesce(F.col("line_no").cast("long"), F.lit(0)).alias("line_no"), "line").withColumn("chunk", F.floor(F.col("line_no") / chunk)).join(picked, "session")
    rows = rows.repartition("session", "chunk").sortWithinPartitions("session", "chunk", "line_no", "line").select("session", "chunk", "s.provider", "s.updated_at", "line")
    lines.sparkSession.dataSource.register(BundleSink)
    rows.write.format("bundle").option("exported_at", exported_at).mode("append").save(path)


def bundles(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, part, version, exported_at) of every manifest at or below a folder; a folder without one gives no row."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", MANIFEST).schema("part string, version int, exported_at long")
    return read.json(root).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("bundle"), "part", "version", "exported_at")


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """What the manifests say of each file; lists of attempts that no manifest names don't count."""
    lists = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "files.jsonl").schema(FILES).json(root)
    at = F.col("_metadata.file_path")
    lists = lists.withColumn("part", F.regexp_extract(at, "(parts/[^/]+)/[^/]+$", 1)).withColumn("bundle", F.regexp_replace(at, "/parts/[^/]+/[^/]+$", ""))
    return lists.join(bundles(spark, root).select("bundle", "part"), ["bundle", "part"], "left_semi").drop("part")


def verified(spark: SparkSession, root: str, provider: str | None = None) -> DataFrame:
    """The files of bundles with found_bytes and verified: there, of the size and digest that the manifest says, and of a version with digests.

    Files are read in blocks by the tasks that check them; a file that isn't
    there has null found_bytes. Newest bundles first is an order by exported_at.
    """
    files = bundle_files(spark, root)
    if provider is not None:
        files = files.where(F.col("provider") == provider)
    wanted = files.select("bundle", "file").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for bundle, file in zip(batch.column("bundle").to_pylist(), batch.column("file").to_pylist(), strict=True):
                where, base = opened(bundle)
                size, digest = 0, hashlib.sha256()
                try:
                    with where.open_input_stream(f"{base}/{file}") as f:
                        while block := f.read(BLOCK):
                            size += len(block)
                            digest.update(block)
                except FileNotFoundError:
                    size = None
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_pydict({"bundle": batch.column("bundle"), "file": batch.column("file"), "found_bytes": pa.array(sizes, pa.int64()), "found_sha256": pa.array(digests, pa.string())})

    found = wanted.repartition("bundle", "file").mapInArrow(check, "bundle string, file string, found_bytes long, found_sha256 string")
    fine = F.coalesce((F.col("found_bytes") == F.col("bytes")) & (F.col("found_sha256") == F.col("sha256")) & (F.col("version") >= VERSION), F.lit(False))
    return files.join(found, ["bundle", "file"], "left").withColumn("verified", fine).drop("found_sha256")

"""Joins over a registry of sessions: cached metadata, documents to search, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cached_metadata(sessions: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """(pk, file, path, metadata, seen_at) of the files of one source's sessions.

    sessions have pk, source and metadata, JSON text that becomes a variant and
    is refused if it doesn't parse; files have session, file, path and seen_at.
    Sessions without a file give no row. Sort by pk and file for a listing.
    """
    own = sessions.where(F.col("source") == source).select("pk", F.parse_json("metadata").alias("metadata"))
    return own.join(files.select(F.col("session").alias("pk"), "file", "path", "seen_at"), "pk")


def search_documents(sessions: DataFrame, projects: DataFrame, texts: DataFrame) -> DataFrame:
    """(pk, title, project, provider, content, tool_names, paths): what a search looks through, a row a known session.

    sessions have pk, title, provider and project_id; projects id and name; texts
    pk, content and the arrays tool_names and paths. A title or project that is
    missing is empty, lists become lines. Texts of sessions that aren't known
    are left to ``unknown_texts``.
    """
    s = sessions.select("pk", F.coalesce("title", F.lit("")).alias("title"), "provider", F.col("project_id").alias("_project"))
    p = projects.select(F.col("id").alias("_project"), F.col("name").alias("project"))
    t = texts.select("pk", "content", F.array_join("tool_names", "\n").alias("tool_names"), F.array_join("paths", "\n").alias("paths"))
    return t.join(s, "pk").join(p, "_project", "left").select("pk", "title", F.coalesce("project", F.lit("")).alias("project"), "provider", "content", "tool_names", "paths")


def unknown_texts(sessions: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that name a session which the registry doesn't have."""
    return texts.join(sessions.select("pk"), "pk", "left_anti")


def search_hits(matches: list[DataFrame], sessions: DataFrame, documents: DataFrame, limit: int = 50) -> DataFrame:
    """(pk, title, project, provider) of the newest sessions that any table of matches names by pk.

    Newest by last change or else creation, then by pk; an empty project is null.
    """
    ids = matches[0].select("pk")
    for more in matches[1:]:
        ids = ids.unionByName(more.select("pk"))
    at = F.coalesce("updated_at", "created_at", F.lit(0))
    found = ids.distinct().join(sessions.select("pk", "title", "provider", at.alias("_at")), "pk").join(documents.select("pk", F.nullif("project", F.lit("")).alias("project")), "pk")
    return found.orderBy(F.desc("_at"), "pk").limit(limit).select("pk", "title", "project", "provider")


def outside_prefix(key: Column, prefix: str) -> Column:
    """Whether a key lies before or behind all keys with a prefix: two ranges that a scan can prune by; null keys don't."""
    return (key < prefix) | (key >= prefix[:-1] + chr(ord(prefix[-1]) + 1))

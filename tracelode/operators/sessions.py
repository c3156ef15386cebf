"""Lists of sessions: filters, scopes, families, orders, joins of side tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import DAY

# Origins of an archived session, their groups and their priorities.
ORIGIN_GROUPS = {"user": "mine", "restored": "mine", "unknown": "mine", "import": "external", "migration": "external", "retention": "automatic", "cleanup": "automatic"}
ORIGIN_PRIORITY = {"unknown": 0, "retention": 1, "cleanup": 2, "migration": 3, "import": 4, "restored": 5, "user": 6}


def _has(text: Column, part: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def workbench(s: DataFrame, provider: str | None = None, project: str | None = None, archived: bool | None = None, text: str = "", columns: tuple[str, ...] = ("title", "cwd", "id", "model")) -> DataFrame:
    """Rows by provider, project, archive state and a text in any of four columns."""
    for column, value in (("provider", provider), ("cwd", project), ("archived", archived)):
        if value is not None:
            s = s.where(F.col(column) == value)
    return s.where(reduce(lambda a, b: a | b, [_has(F.col(c).cast("string"), text.strip()) for c in columns])) if text.strip() else s


def metadata_query(query: str, columns: tuple[str, ...]) -> Column:
    """A condition from ``id:``, ``cwd:``, ``model:``, ``archived:`` or a bare term.

    A bare term of four or more hexadecimal signs also matches the head of an id.
    """
    term = query.strip()
    key, colon, value = term.partition(":")
    key, value = key.strip().lower(), value.strip().lower()
    id_ = F.lower(F.col("id").cast("string"))
    if colon and key == "id":
        return F.startswith(id_, F.lit(value))
    if colon and key in ("cwd", "model"):
        return _has(F.col(key), value)
    if colon and key == "archived":
        return F.col("archived") == (value in ("true", "1", "yes", "on"))
    term = term.lower()
    hits = [_has(F.col(c), term) for c in columns]
    if len(term) >= 4 and all(c in "0123456789abcdef-" for c in term):
        hits.append(F.startswith(id_, F.lit(term)))
    return reduce(lambda a, b: a | b, hits)


def is_subagent(source: Column, nickname: Column, role: Column) -> Column:
    """Whether the source says so, as a word, a parent or JSON with such a key, or a name or role is given."""
    bare = F.trim(source)
    by_json = bare.startswith("{") & F.get_json_object(bare, "$.subagent").isNotNull()
    said = (bare == "subagent") | bare.rlike("^parent:.+") | by_json
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.coalesce(said, F.lit(False)) | some(nickname) | some(role)


def scope(s: DataFrame, which: str, subagent: Column) -> DataFrame:
    """main, subagent, archived or all; an archived sub-agent is in two of them."""
    return {"main": lambda: s.where(~subagent & ~F.col("archived")), "subagent": lambda: s.where(subagent), "archived": lambda: s.where("archived")}.get(which, lambda: s)()


def by_origin(s: DataFrame, ledger: DataFrame, group: str = "mine") -> DataFrame:
    """Archived rows whose origin in the ledger is of the group; without an entry it is unknown."""
    origin = F.coalesce("origin", F.lit("unknown"))
    groups = F.create_map(*[F.lit(x) for pair in ORIGIN_GROUPS.items() for x in pair])
    return s.where("archived").join(ledger.select("id", "origin"), "id", "left").withColumn("origin", origin).where(groups[F.col("origin")] == group)


def winning_origin(events: DataFrame) -> DataFrame:
    """The origin of the highest priority of each id; unknown never takes another's place."""
    rank = F.create_map(*[F.lit(x) for pair in ORIGIN_PRIORITY.items() for x in pair])
    return events.groupBy("id").agg(F.max_by("origin", rank[F.col("origin")]).alias("origin"))


def updated_in(s: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """From start, included, to end, excluded; an unknown time is in no range."""
    for limit, test in ((start, F.col("updated_at") >= F.lit(start)), (end, F.col("updated_at") < F.lit(end))):
        s = s if limit is None else s.where(test)
    return s


def family_active(s: DataFrame, branches: DataFrame) -> DataFrame:
    """Rows outside families and the active one of each; branches have family, id and active_id."""
    joined = s.join(branches.select("id", "family", "active_id"), "id", "left")
    return joined.where(F.col("family").isNull() | (F.col("id") == F.col("active_id")))


def dangling_families(s: DataFrame, index: DataFrame, families: DataFrame, provider: str) -> DataFrame:
    """(id, family): sessions of a provider that the index (id, family) puts into a family that isn't in families (family).

    Such an index can't be trusted: a caller of family_active refuses to go on unless this is empty.
    """
    mine = s.where(F.col("provider") == provider).select("id")
    return index.where("family is not null").join(mine, "id", "left_semi").join(families.select("family"), "family", "left_anti").select("id", "family")


def representatives(s: DataFrame, provider: str | None = None) -> DataFrame:
    """One row of each family: of the current provider if there is one, else active, else any.

    Of those the newest by update, then an active one, the newest by creation, the least id.
    """
    w = W.partitionBy("family")
    mine = F.coalesce(F.col("provider") == provider, F.lit(False)) if provider else F.lit(False)
    pool = F.when(mine, 2).when(F.col("active"), 1).otherwise(0)
    nth = F.row_number().over(w.orderBy(F.desc("_pool"), F.desc("updated_at"), F.desc("active"), F.desc("created_at"), "id"))
    return s.where("family is not null").withColumn("_pool", pool).withColumn("_n", nth).where("_n = 1").drop("_pool", "_n").unionByName(s.where("family is null"))


def by_activity(s: DataFrame) -> list[Column]:
    return [F.desc("updated_at"), F.desc("created_at"), F.asc("id")]


def by_size(size: str = "tokens_used", bytes_: str = "rollout_bytes", ascending: bool = False) -> list[Column]:
    turn = F.asc if ascending else F.desc
    return [turn(size), turn(bytes_), F.desc("updated_at"), F.asc("id")]


def page(s: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of an order, with their place."""
    return s.orderBy(*order).limit(offset + limit).withColumn("place", F.row_number().over(W.orderBy(*order))).where(F.col("place") > offset)


def recency(updated: Column, today: int) -> Column:
    """today, yesterday, week (7 days), month (30 days) or earlier, against the start of a day."""
    return F.when(updated >= today, "today").when(updated >= today - DAY, "yesterday").when(updated >= today - 6 * DAY, "week").when(updated >= today - 29 * DAY, "month").otherwise("earlier")


def title(index_title: Column, name: Column, db_title: Column, first_message: Column) -> Column:
    """A name given, else the index's title, else the database's unless that only repeats the prompt."""
    known = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(known(name), known(index_title), F.when(F.trim(db_title) != F.trim(F.coalesce(first_message, F.lit(""))), known(db_title)), known(db_title), F.lit(""))


def overlay_with_ledger(overlay: DataFrame, ledger: DataFrame) -> DataFrame:
    """What the ledger says of a session, else what the overlay does."""
    return overlay.join(ledger.select("id", F.col("origin").alias("_said")), "id", "left").withColumn("origin", F.coalesce("_said", "origin")).drop("_said")


def live_and_indexed(live: DataFrame, indexed: DataFrame, key: list[str]) -> DataFrame:
    """Live rows, and indexed ones that are not live."""
    return live.unionByName(indexed.join(live.select(*key).distinct(), key, "left_anti"))


def unresolved(wanted: DataFrame, s: DataFrame, key: list[str]) -> DataFrame:
    """Wanted keys without a session."""
    return wanted.join(s, key, "left_anti")


def newest_places(rows: DataFrame, key: list[str], time: str, keep: int) -> DataFrame:
    """The latest row of each key, and of those the newest so many."""
    latest = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(time), F.desc("event_id")))).where("_n = 1").drop("_n")
    return latest.orderBy(F.desc(time), *key).limit(keep)


def prefixes_of(path: Column, root: str = "/") -> Column:
    """All heads of a path that end at a separator, and the path itself."""
    parts = F.split(path, root)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), root))


def longest_prefix(rows: DataFrame, path: str, projects: DataFrame, project: str) -> DataFrame:
    """Rows with the longest project path that is a head of theirs.

    Heads are exploded and joined by equality, so a large project table needs
    no nested loop: a row makes as many heads as its path has parts.
    """
    heads = rows.select("*", F.explode(prefixes_of(F.col(path))).alias("_head"))
    found = heads.join(projects.select(F.col(project).alias("_head")).distinct(), "_head")
    best = found.groupBy(path).agg(F.max_by("_head", F.length("_head")).alias("project"))
    return rows.join(best, path, "left")

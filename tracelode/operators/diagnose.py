"""Consistency of what is stored: id sets, families, origins, digests, plans of repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .sessions import ORIGIN_PRIORITY


def id_sets(sets: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """(id, a column of flags for each set): one pass over all sets instead of a join for each pair."""
    named = [df.select(F.col(id_col).alias("id"), F.lit(name).alias("which")) for name, df in sets.items()]
    rows = named[0]
    for more in named[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("id").agg(*[F.max(F.col("which") == name).alias(name) for name in sets])


def set_diff(sets: dict[str, DataFrame], pairs: Sequence[tuple[str, str]], id_col: str = "id") -> DataFrame:
    """(problem, id) of every id that is in the first set of a pair and not in the second."""
    flags = id_sets(sets, id_col)
    found = F.array_compact(F.array(*[F.when(F.col(a) & ~F.col(b), f"in {a} not in {b}") for a, b in pairs]))
    return flags.select(F.explode(found).alias("problem"), "id")


def state_counts(logs: DataFrame, index: DataFrame, threads: DataFrame, orphans: DataFrame, mismatched: DataFrame) -> DataFrame:
    """One row of counts over what logs, index and threads hold, by different ids.

    logs and threads have id and archived, the others id. Ids that are null
    count nowhere but in archived_logs, which counts files. An id missing in
    threads or index is one of a live log; a thread is an orphan if no log,
    archived ones included, has it, an index entry if no live log has it.
    """
    part = lambda df, which: df.select("id", F.lit(which).alias("which"))
    rows = part(logs.where(~F.col("archived")), "live").unionByName(part(logs.where("archived"), "away")).unionByName(part(index, "index"))
    rows = rows.unionByName(part(threads.where(~F.col("archived")), "active")).unionByName(part(threads.where("archived"), "kept"))
    rows = rows.unionByName(part(orphans, "orphan")).unionByName(part(mismatched, "mismatch"))
    names = ("live", "away", "index", "active", "kept", "orphan", "mismatch")
    ids = rows.groupBy("id").agg(*[(F.max(F.col("which") == n) & F.col("id").isNotNull()).alias(n) for n in names], F.count_if(F.col("which") == "away").alias("files"))
    live, away, indexed, thread = F.col("live"), F.col("away"), F.col("index"), F.col("active") | F.col("kept")
    return ids.agg(
        F.count_if(live).alias("logs"), F.coalesce(F.sum("files"), F.lit(0)).alias("archived_logs"), F.count_if(indexed).alias("index"),
        F.count_if(thread).alias("threads"), F.count_if("active").alias("threads_active"), F.count_if("kept").alias("threads_archived"),
        F.count_if(live & ~indexed).alias("missing_in_index"), F.count_if(live & ~thread).alias("missing_in_threads"),
        F.count_if(indexed & ~live).alias("orphan_in_index"), F.count_if(thread & ~live & ~away).alias("orphan_in_threads"),
        F.count_if("orphan").alias("orphan_subagents"), F.count_if("mismatch").alias("mismatched"),
    )


def history_links(history: DataFrame, known: DataFrame, id_col: str = "session") -> DataFrame:
    """One row: history rows in all, with a known session, with an unknown one, without one, and different unknown ones."""
    ids = known.select(F.col(id_col).alias("_known")).distinct()
    named = F.coalesce(F.trim(F.col(id_col).cast("string")) != "", F.lit(False))
    h = history.select(F.col(id_col).alias("s"), named.alias("named")).join(ids, F.col("s") == F.col("_known"), "left")
    orphan = F.col("named") & F.col("_known").isNull()
    return h.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_known").isNotNull()).alias("linked"),
        F.count_if(orphan).alias("orphan"),
        F.count_if(~F.col("named")).alias("untracked"),
        F.countDistinct(F.when(orphan, F.col("s"))).alias("orphan_ids"),
    )


def clone_state(provider: Column, current: Column, has_clone: Column, subagent: Column, archived: Column, usable: Column, available: Column) -> Column:
    """What cloning a session to the current provider would mean; earlier conditions win."""
    both = provider.isNotNull() & current.isNotNull()
    return (
        F.when(archived, "matches").when(subagent, "subagent").when(~available | ~both, "unknown")
        .when(provider == current, F.when(usable, "matches").otherwise("resync"))
        .when(has_clone, "has_clone").otherwise("clonable")
    )


def verify_digests(manifest: DataFrame, objects: DataFrame, by: str = "session") -> DataFrame:
    """(by, name, state) of every member of a manifest: missing, wrong size, wrong digest or ok.

    manifest has by, name, size and sha256; objects have name and data.
    """
    data = F.col("data").cast("binary")
    have = objects.select("name", F.octet_length(data).cast("long").alias("_size"), F.sha2(data, 256).alias("_sha"))
    state = F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("size"), "wrong size").when(F.col("_sha") != F.lower("sha256"), "wrong digest").otherwise("ok")
    return manifest.join(have, "name", "left").select(by, "name", state.alias("state"))


def verified(states: DataFrame, by: str = "session") -> DataFrame:
    """(by, n, n_bad, all_ok) of verified members."""
    return states.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("state") != "ok").alias("n_bad"), F.every(F.col("state") == "ok").alias("all_ok"))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(name, data) of objects from chunks (name, seq, data) in their order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda c: F.decode(c["data"], "ISO-8859-1"))
    return chunks.groupBy("name").agg(F.encode(F.array_join(parts, ""), "ISO-8859-1").alias("data"))


def keep_newer(local: DataFrame, bundle: DataFrame, key: str = "session", at: str = "at") -> DataFrame:
    """(key, keep_local, reason): the bundle wins only if both sides have a time and its last one is later."""
    last = lambda df, name: df.groupBy(key).agg(F.max(at).alias(name))
    both = last(local, "here").join(last(bundle, "there"), key)
    reason = F.when(F.col("here").isNull(), "no local time").when(F.col("there").isNull(), "no bundle time").when(F.col("here") >= F.col("there"), "local is newer or the same")
    return both.select(key, reason.isNotNull().alias("keep_local"), reason.alias("reason"))


def origin_of(events: DataFrame, key: str = "id") -> DataFrame:
    """(key, origin): the origin of highest priority; unknown only where there is no other."""
    priority = F.create_map(*[F.lit(x) for kv in ORIGIN_PRIORITY.items() for x in kv])
    rank = F.coalesce(F.try_element_at(priority, F.col("origin")), F.lit(-1))
    return events.groupBy(key).agg(F.max_by("origin", F.struct(rank, "origin")).alias("origin"))


def family_problems(families: DataFrame, branches: DataFrame, index: DataFrame) -> DataFrame:
    """(family, problem): no branches, an active one outside the chain, a branch in several families, index rows at odds.

    families have family and active; branches family and id; index id and family.
    """
    kinds = []
    chain = branches.select("family", "id").distinct()
    kinds.append(families.join(chain, "family", "left_anti").select("family", F.lit("no branches").alias("problem")))
    kinds.append(families.join(chain.select("family", F.col("id").alias("active")), ["family", "active"], "left_anti").select("family", F.lit("active is no branch").alias("problem")))
    shared = chain.withColumn("n", F.count("*").over(W.partitionBy("id"))).where("n > 1")
    kinds.append(shared.select("family", F.lit("branch in several families").alias("problem")).distinct())
    kinds.append(chain.join(index, ["family", "id"], "left_anti").select("family", F.lit("branch without index").alias("problem")).distinct())
    kinds.append(index.join(chain, ["family", "id"], "left_anti").select("family", F.lit("index without branch").alias("problem")).distinct())
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def prune_plan(families: DataFrame, branches: DataFrame) -> DataFrame:
    """(family, action, active) of families some of whose branches may be lost.

    families have family, active, consistent and repairable; branches family,
    id, live and exists. Without a branch left a consistent family is dropped;
    a lost active branch gives way to the only live one left; one that is
    there but at odds with the rest is normalised; lost others are pruned.
    """
    b = branches.join(families.select("family", "active"), "family")
    n = b.groupBy("family").agg(
        F.count_if("exists").alias("left"), F.count_if(~F.col("exists")).alias("lost"),
        F.max(F.col("exists") & (F.col("id") == F.col("active"))).alias("has_active"),
        F.count_if(F.col("exists") & F.col("live")).alias("live_left"),
        F.min(F.when(F.col("exists") & F.col("live"), F.col("id"))).alias("only"),
    )
    f = families.join(n, "family", "left").fillna({"left": 0, "lost": 0, "live_left": 0, "has_active": False})
    action = (
        F.when(F.col("left") == 0, F.when(F.col("consistent"), "drop").otherwise("skip"))
        .when(~F.col("has_active"), F.when((F.col("live_left") == 1) & F.col("repairable"), "recover").otherwise("skip"))
        .when(~F.col("consistent"), F.when(F.col("repairable"), "normalise").otherwise("skip"))
        .when(F.col("lost") > 0, "prune").otherwise("keep")
    )
    return f.select("family", action.alias("action"), F.when(action == "recover", F.col("only")).otherwise(F.col("active")).alias("active"))


def title_visibility(rows: DataFrame) -> DataFrame:
    """(path, state) of logs: empty, sidechain, visible, fixable or unfixable.

    rows have path, line_no, sidechain, title and prompt. A title among the
    first or last lines is visible; without one a prompt makes it fixable.
    """
    ends = rows.withColumn("back", F.row_number().over(W.partitionBy("path").orderBy(F.desc("line_no"))))
    edge = (F.col("line_no") < 50) | (F.col("back") <= 50)
    named = F.coalesce(F.trim("title") != "", F.lit(False))
    n = ends.groupBy("path").agg(F.count_if(named & edge).alias("shown"), F.count_if(named).alias("named"), F.count_if(F.coalesce(F.trim("prompt") != "", F.lit(False))).alias("prompts"), F.min_by("sidechain", "line_no").alias("side"), F.count("line_no").alias("n"))
    state = F.when(F.col("n") == 0, "empty").when(F.col("side"), "sidechain").when(F.col("shown") > 0, "visible").when((F.col("named") > 0) | (F.col("prompts") > 0), "fixable").otherwise("unfixable")
    return n.select("path", state.alias("state"))


def auto_cwd(candidates: DataFrame, key: str = "session") -> DataFrame:
    """(key, cwd): the exact directory if it is there, else the only one that is, else null."""
    there = F.when(F.col("available"), F.col("cwd"))
    exact = F.max(F.when(F.col("available") & F.col("exact"), F.col("cwd")))
    return candidates.groupBy(key).agg(F.coalesce(exact, F.when(F.countDistinct(there) == 1, F.max(there))).alias("cwd"))


def inbox(items: DataFrame) -> DataFrame:
    """One item a key, errors before warnings and newer before older, with a place in the list."""
    severity = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    first = W.partitionBy("key").orderBy(severity, F.desc("at"), "id")
    return items.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def winning_values(events: DataFrame) -> DataFrame:
    """(key, value, conflict): the value of the latest stamp; a conflict where that stamp has several."""
    last = events.groupBy("key").agg(F.max("stamp").alias("stamp"))
    return events.join(last, ["key", "stamp"]).groupBy("key").agg(F.min("value").alias("value"), (F.countDistinct("value") > 1).alias("conflict"))


def residue(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, rows, bytes, sessions) of key-value rows ns:session:sub whose session isn't known."""
    part = F.split("key", ":")
    named = rows.select(part[0].alias("kind"), part[1].alias("session"), F.octet_length(F.col("value").cast("binary")).alias("size"))
    lost = named.join(known.select(F.col("session").cast("string").alias("session")).distinct(), "session", "left_anti")
    return lost.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("size").cast("long").alias("bytes"), F.countDistinct("session").alias("sessions"))


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank p50 and p95, and the greatest value."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(p * 100)}")
    return rows.groupBy(*by).agg(F.count(value).alias("n"), at(0.5), at(0.95), F.max(value).alias("max"))


def provider_mismatch(sessions: DataFrame, current: str, branches: DataFrame) -> DataFrame:
    """Sessions of another provider than the current one: of a family only its active branch, of no family any that isn't archived."""
    b = branches.select("id", "family", "active")
    s = sessions.join(b, "id", "left").where(F.coalesce(F.col("provider") != current, F.lit(True)))
    return s.where(F.coalesce(F.col("active"), ~F.col("archived"))).select("id", "provider", "family")


def health_report(checks: DataFrame) -> DataFrame:
    """Different findings of each provider, the gravest first: (provider, severity, message, place)."""
    grave = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rows = checks.select("provider", "severity", "message").distinct()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("provider").orderBy(grave, "message")).cast("long"))


def resume_places(locations: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, cwd, origin): a session's own directory and its project's locations, each directory once, the own one first."""
    own = sessions.select("session", "cwd", F.lit(0).alias("rank"))
    more = sessions.join(locations, "project").select("session", locations["path"].alias("cwd"), F.lit(1).alias("rank"))
    best = own.unionByName(more).where("cwd is not null").groupBy("session", "cwd").agg(F.min("rank").alias("rank"))
    return best.select("session", "cwd", F.when(F.col("rank") == 0, "session").otherwise("project").alias("origin"))

"""Transcripts in order: turns, answers, prompts, inclusion, gaps, chunks, comparison.

A transcript row has session, idx (its place), role, text and, where told,
phase. Everything is a window or an aggregate over a session, so one shuffle by
session serves several of these in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHUNK = 40


def _in_session(*order: str | Column):
    return W.partitionBy("session").orderBy(*(order or ("idx",)))


def turns(t: DataFrame) -> DataFrame:
    """Rows with their turn: 0 before the first user row, one more from each."""
    return t.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(_in_session().rowsBetween(W.unboundedPreceding, 0)))


def assign_phases(t: DataFrame) -> DataFrame:
    """An assistant row that ends its turn is the final answer, others are commentary; without a turn neither."""
    last = F.col("idx") == F.max("idx").over(W.partitionBy("session", "turn"))
    phase = F.when((F.col("role") == "assistant") & (F.col("turn") > 0), F.when(last, "final_answer").otherwise("commentary"))
    return turns(t).withColumn("phase", phase)


def _answer(idx: Column) -> Column:
    """The place of a turn's answer: the last final one if phases are told, else the last assistant row."""
    told = F.max(F.when((F.col("role") == "assistant") & F.col("phase").isNotNull(), 1))
    final = F.max(F.when((F.col("role") == "assistant") & (F.col("phase") == "final_answer"), idx))
    return F.when(told == 1, final).otherwise(F.max(F.when(F.col("role") == "assistant", idx)))


def final_answers(t: DataFrame) -> DataFrame:
    """The answer of every turn that has one."""
    return turns(t).groupBy("session", "turn").agg(_answer(F.col("idx")).alias("answer")).where("answer is not null")


def display(t: DataFrame) -> DataFrame:
    """Rows to show: of a turn's assistant rows the answer only."""
    w = W.partitionBy("session", "turn")
    told = F.max(F.when((F.col("role") == "assistant") & F.col("phase").isNotNull(), 1)).over(w)
    final = F.max(F.when((F.col("role") == "assistant") & (F.col("phase") == "final_answer"), F.col("idx"))).over(w)
    last = F.max(F.when(F.col("role") == "assistant", F.col("idx"))).over(w)
    answer = F.when(told == 1, final).otherwise(last)
    return turns(t).withColumn("_a", answer).where((F.col("role") != "assistant") | (F.col("idx") == F.col("_a"))).drop("_a")


def prompt_timeline(t: DataFrame, active: Column | None = None) -> DataFrame:
    """Each user row with its best response.

    A final answer wins, then the last row with a phase, then the last one
    without. A prompt that nothing followed is left out unless it is the last.
    """
    active = F.col("role") != "user" if active is None else active
    said = (F.col("role") == "assistant") & (F.trim("text") != "")
    at = lambda test: F.max(F.when(said & test, F.col("idx")))
    told = F.col("phase").isNotNull()
    g = turns(t).where("turn > 0").groupBy("session", "turn")
    rows = g.agg(
        F.min(F.when(F.col("role") == "user", F.col("idx"))).alias("prompt"),
        F.max(active.cast("int")).alias("_active"),
        F.coalesce(at(F.col("phase") == "final_answer"), at(told), at(~told)).alias("response"),
    )
    last = F.col("turn") == F.max("turn").over(W.partitionBy("session"))
    return rows.withColumn("_last", last).where("_active = 1 or _last").select("session", "turn", "prompt", "response")


def in_time(t: DataFrame, start: int | None, end: int | None, time: str = "at") -> DataFrame:
    """From start, included, to end, excluded; a row without a time always passes."""
    for limit, test in ((start, F.col(time) >= F.lit(start)), (end, F.col(time) < F.lit(end))):
        t = t if limit is None else t.where(F.col(time).isNull() | test)
    return t


def inclusion(t: DataFrame, message: Column, chosen: Column) -> DataFrame:
    """Messages as chosen; other rows follow the next message, or the one before where none comes."""
    # What comes after is read backwards: a frame to the end is run through anew for every row.
    after = F.last(F.when(message, chosen), ignorenulls=True).over(_in_session(F.desc("idx")).rowsBetween(W.unboundedPreceding, 0))
    before = F.last(F.when(message, chosen), ignorenulls=True).over(_in_session().rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("included", F.when(message, chosen).otherwise(F.coalesce(after, before, F.lit(False))))


def search_gaps(t: DataFrame, visible: Column) -> DataFrame:
    """Before each visible row but the first, how many hidden ones lie since the last, where any do."""
    place = F.row_number().over(_in_session())
    shown = t.withColumn("_p", place).where(visible)
    gap = F.col("_p") - F.lag("_p").over(_in_session()) - 1
    return shown.withColumn("hidden", gap).where("hidden > 0").drop("_p")


def latest(t: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key."""
    return t.groupBy(key).agg(F.max_by(value, order).alias(value))


def ends(t: DataFrame, n_first: int, n_last: int, kind: str = "role") -> DataFrame:
    """The first and the last so many rows of each kind in a session."""
    w = W.partitionBy("session", kind)
    head, tail = F.row_number().over(w.orderBy("idx")), F.row_number().over(w.orderBy(F.desc("idx")))
    return t.withColumn("nth", head).withColumn("nth_last", tail).where((F.col("nth") <= n_first) | (F.col("nth_last") <= n_last))


def coalesce_chunks(t: DataFrame, key: str) -> DataFrame:
    """Adjacent rows of one key as one row with their texts joined in order."""
    new = F.coalesce((F.col(key) != F.lag(key).over(_in_session())).cast("int"), F.lit(1))
    runs = t.withColumn("_new", new).withColumn("run", F.sum("_new").over(_in_session().rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return runs.groupBy("session", "run").agg(F.min("idx").alias("first"), F.count("*").alias("chunks"), F.first(key).alias(key), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def prefix_compare(pairs: DataFrame) -> DataFrame:
    """How a branch stands to the active log; pairs have pair, line (from 0), active and branch.

    A side without a line is null there. The first line is not compared.
    """
    body = pairs.where("line > 0")
    same = F.min(F.when(~F.col("active").eqNullSafe(F.col("branch")), F.col("line")))
    size = lambda c: F.count(c)
    g = body.groupBy("pair").agg(same.alias("_at"), size("active").alias("n_active"), size("branch").alias("n_branch"))
    common = F.coalesce(F.col("_at") - 1, F.greatest("n_active", "n_branch"))
    state = F.when(F.col("_at").isNull(), "same").when(common == F.col("n_active"), "branch_ahead").when(common == F.col("n_branch"), "active_ahead").otherwise("diverged")
    ahead = F.when(state == "branch_ahead", F.col("n_branch") - F.col("n_active")).when(state == "active_ahead", F.col("n_active") - F.col("n_branch")).otherwise(0)
    return g.select("pair", common.cast("long").alias("common"), state.alias("state"), ahead.cast("long").alias("ahead"))


def prefix_to(t: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows up to the cut of their session; a cut must be a user or assistant row."""
    stable = t.join(cuts, "session").where((F.col("idx") == F.col("cut")) & F.col("role").isin("user", "assistant")).select("session", "cut")
    return t.join(stable, "session").where("idx <= cut").drop("cut")


def in_chunks(t: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows with the number of their chunk of so many rows."""
    return t.withColumn("chunk", F.floor((F.row_number().over(_in_session()) - 1) / size))


def time_span(t: DataFrame, time: str = "at") -> DataFrame:
    """First and last minute of each session, and whether it spans several days."""
    minute = F.floor(F.col(time) / 60) * 60
    return t.groupBy("session").agg(F.min(minute).alias("first"), F.max(minute).alias("last"), (F.count_distinct(F.floor(F.col(time) / 86400)) > 1).alias("several_days"))


def nearest_mirror(t: DataFrame, kind: str, opposite: dict[str, str]) -> DataFrame:
    """Rows with the nearest row of the same text and the opposite kind; of two equally near the one before.

    The nearest on either side comes from frames that begin at one end, each row
    read once, so a text that repeats n times takes n steps a side. Rows of one
    place see each other.
    """
    group = W.partitionBy("session", "text")
    up, down = (group.orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in ("idx", F.desc("idx")))
    out = t.withColumn("mirror", F.lit(None).cast("long"))
    best = F.lit(None)
    for mine, other in opposite.items():
        before, after = (F.last(F.when(F.col(kind) == other, F.col("idx")), ignorenulls=True).over(w) for w in (up, down))
        near = F.when(after.isNull() | (F.col("idx") - before <= after - F.col("idx")), F.coalesce(before, after)).otherwise(after)
        best = F.when(F.col(kind) == mine, near).otherwise(best)
    return out.withColumn("mirror", best)


def counter_deltas(c: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """A cumulative counter as differences; a fall starts a new epoch, whose first value counts whole."""
    w = W.partitionBy(key).orderBy(order)
    before = F.lag(total).over(w)
    reset = F.coalesce((F.col(total) < before).cast("int"), F.lit(0))
    rows = c.withColumn("_b", before).withColumn("_r", reset)
    epoch = F.sum("_r").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("delta", F.when(F.col("_b").isNull() | (F.col("_r") == 1), F.col(total)).otherwise(F.col(total) - F.col("_b"))).withColumn("epoch", epoch).drop("_b", "_r")


def prefix_problems(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(session, problem): why no branch can begin at a cut, null if one can.

    rows have session, idx, bad (not JSON), outer, kind and role as their lines
    say; cuts session and cut. Up to the cut all lines must be good; the cut
    must be there and be a message of a user or an assistant; the first line
    must be the session's head. The first rule that fails is given; a cut comes
    once a session.
    """
    before = cuts.join(rows, "session", "left").where("idx is null or idx <= cut")
    good = ~F.coalesce("bad", F.lit(False))
    outer, kind = F.coalesce("outer", F.lit("")), F.coalesce("kind", F.lit(""))
    stable = (outer == "event_msg") & kind.isin("user_message", "agent_message") | (outer == "response_item") & (kind == "message") & F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    at_cut = F.col("idx") == F.col("cut")
    facts = before.groupBy("session").agg(
        F.max(F.coalesce(~good & F.col("idx").isNotNull(), F.lit(False))).alias("broken"),
        F.max(F.coalesce(at_cut, F.lit(False))).alias("there"),
        F.max(F.coalesce(at_cut & stable, F.lit(False))).alias("stable"),
        F.min_by(outer, "idx").alias("first"),
    )
    problem = F.when(F.col("broken"), "bad line").when(~F.col("there"), "no such line").when(~F.col("stable"), "no message").when(~F.coalesce(F.col("first") == "session_meta", F.lit(False)), "no head")
    return cuts.select("session").distinct().join(facts, "session", "left").select("session", F.coalesce(problem, F.when(F.col("broken").isNull(), "no such line")).alias("problem"))

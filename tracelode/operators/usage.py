"""Token usage: prices, summaries, trends, period comparison, ranking, price catalogue.

A usage row has provider, session, cwd, model, date (YYYY-MM-DD or null) and
six token counts. reasoning is part of output and cache_write_1h of
cache_write, so neither is ever added to a total. What is not known stays
apart from zero: an unpriced field is counted, not priced at nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import SAFE
from .order import placed

TOKENS = ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning")
#: Billed fields, each with its rate column and its tokens.
BILLED = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
RATES = dict(zip(BILLED, ("r_input", "r_output", "r_cache_read", "r_write_5m", "r_write_1h"), strict=True))


def billed(field: str) -> Column:
    """Tokens of a billed field; what isn't an hour's cache write is a 5-minute one."""
    return F.greatest(F.lit(0), F.col("cache_write") - F.col("cache_write_1h")) if field == "cache_write_5m" else F.col(field)


def invalid() -> Column:
    """Counts that can't be right: negative, beyond exact numbers, or a part larger than its whole."""
    odd = [F.col(t).isNull() | (F.col(t) < 0) | (F.col(t) > SAFE) for t in TOKENS]
    return reduce(lambda a, b: a | b, [*odd, F.col("cache_write_1h") > F.col("cache_write"), F.col("reasoning") > F.col("output")])


def _rated(field: str) -> Column:
    rate = F.col(RATES[field])
    return rate.isNotNull() & ~F.isnan(rate) & (rate >= 0) & (rate < float("inf"))


def total_tokens() -> Column:
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")


def merged(usage: DataFrame, *by: str) -> DataFrame:
    """Token sums by the given columns; an overflow of a long is an error under ANSI rules."""
    return usage.groupBy(*by).agg(*[F.sum(t).cast("long").alias(t) for t in TOKENS])


def usage_daily(usage: DataFrame) -> DataFrame:
    """Sums by session, date and model; rows without a date form their own group."""
    return merged(usage, "provider", "session", "date", "model")


def undated(usage: DataFrame) -> DataFrame:
    """Sums of what has no valid date, which counts in no range of dates."""
    return merged(usage.where(F.col("date").isNull() | ~valid_date(F.col("date"))), "provider", "session", "model")


def valid_date(date: Column) -> Column:
    return date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date, "yyyy-MM-dd").isNotNull()


def in_dates(usage: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Dated rows from start to end, both included; without either everything, undated rows too."""
    if start is None and end is None:
        return usage
    kept = usage.where(valid_date(F.col("date")))
    kept = kept if start is None else kept.where(F.col("date") >= start)
    return kept if end is None else kept.where(F.col("date") <= end)


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows with micro (known cost in millionths), unknown (fields without a rate) and invalid.

    The price book joins by provider and model; Spark broadcasts it by its own
    measure of its size. Fields of no tokens need no rate. A field whose cost,
    or the cost up to it, is beyond exact numbers is unknown. Invalid rows cost
    nothing and every field of theirs is unknown.
    """
    joined = rows.join(prices, ["provider", "model"], "left").withColumn("invalid", invalid())
    values = F.array(*[F.when(billed(f) <= 0, 0.0).when(_rated(f), billed(f) * F.col(RATES[f])) for f in BILLED])
    most = F.lit(SAFE * 1e6)
    start = F.struct(F.lit(0.0).alias("known"), F.lit(0).alias("unknown"))

    def add(acc: Column, value: Column) -> Column:
        fits = value.isNotNull() & (acc["known"] + value <= most)
        return F.struct(F.when(fits, acc["known"] + value).otherwise(acc["known"]).alias("known"), F.when(fits, acc["unknown"]).otherwise(acc["unknown"] + 1).alias("unknown"))

    joined = joined.withColumn("_cost", F.aggregate(values, start, add))
    return joined.withColumn("micro", F.when(F.col("invalid"), 0.0).otherwise(F.col("_cost.known"))).withColumn("unknown", F.when(F.col("invalid"), len(BILLED)).otherwise(F.col("_cost.unknown"))).drop("_cost", *RATES.values())


def summarise(rows: DataFrame, prices: DataFrame, *by: str) -> DataFrame:
    """Sums, known cost, models with unknown prices and overflow, by the given columns or over all.

    rows hold one row for each session and model of a group.
    """
    p = priced(rows, prices)
    wide = lambda t: F.sum(F.col(t).cast("decimal(38,0)"))
    p = p.groupBy(*by) if by else p
    out = p.agg(
        F.count_distinct("provider", "session").alias("sessions"),
        *[wide(t).alias(t) for t in TOKENS],
        (F.sum("micro") / 1_000_000).alias("known"),
        F.sum((F.col("unknown") > 0).cast("int")).cast("long").alias("unknown_models"),
        F.max("invalid").alias("any_invalid"),
    )
    over = reduce(lambda a, b: a | b, [(F.col(t) > SAFE) | (F.col(t) < 0) for t in TOKENS])
    out = out.withColumn("overflow", F.coalesce(over, F.lit(False)) | F.coalesce("any_invalid", F.lit(False)) | F.coalesce(total_tokens() > SAFE, F.lit(False))).drop("any_invalid")
    return out.select(*by, "sessions", *[F.coalesce(F.when(F.col(t) <= SAFE, F.col(t)).cast("long"), F.lit(0)).alias(t) for t in TOKENS], F.coalesce("known", F.lit(0.0)).alias("known"), F.coalesce("unknown_models", F.lit(0)).alias("unknown_models"), "overflow")


def quality(usage: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: of the listed sessions (provider, session, warned) how many have no usage and how many warnings."""
    seen = usage.select("provider", "session").distinct().withColumn("seen", F.lit(True))
    one = listed.groupBy("provider", "session").agg(F.max("warned").alias("warned")).join(seen, ["provider", "session"], "left")
    return one.agg(F.count_if(F.col("seen").isNull()).alias("missing_sessions"), F.count_if("warned").alias("warned_sessions"))


def usage_summary(usage: DataFrame, prices: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Summary over all; with a list of all sessions also how many lack usage or have warnings."""
    out = summarise(merged(usage, "provider", "session", "model"), prices)
    return out if listed is None else out.join(quality(usage, listed))  # a row each


def usage_by(usage: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Summary by model (of a provider) or by project (cwd)."""
    by = ("provider", "model") if key == "model" else ("cwd",)
    return summarise(merged(usage, "provider", "session", "cwd", "model"), prices, *by)


def daily_trend(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """By date: sessions, tokens, known cost, and whether something of it is unknown."""
    rows = merged(usage.where(valid_date(F.col("date"))), "provider", "session", "date", "model")
    out = summarise(rows, prices, "date")
    return out.select("date", "sessions", total_tokens().alias("tokens"), "known", "unknown_models", (F.col("overflow") | (F.col("unknown_models") > 0)).alias("incomplete"))


def period_comparison(usage: DataFrame, prices: DataFrame, today: str, days: int, listed: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """The last so many days up to and with today against as many before, in one row.

    reasons lists why figures can't be compared: the analysis isn't complete,
    listed sessions have warnings or no usage, usage has no date, something of
    the whole usage is beyond exact numbers, a period is empty. Deltas and
    percents are null then. A percent needs a previous figure that is not zero
    (or two zeros), and that of cost needs every price.
    """
    if days not in (7, 30):
        raise ValueError("a period has 7 or 30 days")
    back = lambda n: F.date_format(F.date_sub(F.lit(today).cast("date"), n), "yyyy-MM-dd")
    date = F.col("date")
    period = F.when(date.between(back(days - 1), back(0)), "current").when(date.between(back(2 * days - 1), back(days)), "previous")
    dated = usage.where(valid_date(date)).withColumn("period", period)
    both = summarise(merged(dated.where("period is not null"), "period", "provider", "session", "model"), prices, "period")
    side = lambda name, c: F.max(F.when(F.col("period") == name, c))
    figures = both.agg(
        *[side(n, total_tokens()).alias(f"{n}_tokens") for n in ("current", "previous")],
        *[side(n, F.col("known")).alias(f"{n}_known") for n in ("current", "previous")],
        F.coalesce(F.sum("unknown_models"), F.lit(0)).alias("unknown_models"),
        F.coalesce(F.max("overflow"), F.lit(False)).alias("overflow"),
    )
    loose = usage.where(date.isNull() | ~valid_date(date)).select("provider", "session").distinct().agg(F.count("*").alias("undated_sessions"))
    scope = usage_summary(usage, prices).select(F.col("overflow").alias("scope_overflow"))
    doubts = quality(usage, usage.select("provider", "session", F.lit(False).alias("warned")) if listed is None else listed)
    rows = figures.join(loose).join(scope).join(doubts)  # a row each
    reasons = F.array_compact(
        F.array(
            F.when(F.lit(not complete), "analysis incomplete"),
            F.when(F.col("warned_sessions") > 0, "sessions with warnings"),
            F.when(F.col("missing_sessions") > 0, "sessions without usage"),
            F.when(F.col("undated_sessions") > 0, "undated usage"),
            F.when(F.col("overflow") | F.col("scope_overflow"), "beyond exact numbers"),
            F.when(F.col("current_tokens").isNull() | F.col("previous_tokens").isNull(), "a period has no usage"),
        )
    )
    rows = rows.withColumn("reasons", F.array_join(reasons, "; "))
    fine = F.col("reasons") == ""
    delta = lambda m: F.when(fine, F.col(f"current_{m}") - F.col(f"previous_{m}"))
    percent = lambda m: F.when(fine & (F.col(f"previous_{m}") != 0), (F.col(f"current_{m}") - F.col(f"previous_{m}")) / F.col(f"previous_{m}") * 100).when(fine & (F.col(f"current_{m}") == 0), 0.0)
    return rows.select(
        "current_tokens", "previous_tokens", "current_known", "previous_known", "undated_sessions", "missing_sessions", "warned_sessions", "reasons",
        delta("tokens").alias("tokens_delta"), percent("tokens").alias("tokens_percent"), delta("known").alias("known_delta"),
        F.when(F.col("unknown_models") == 0, percent("known")).alias("known_percent"),
    )


def rank(usage: DataFrame, prices: DataFrame, key: str, sort: str = "tokens") -> DataFrame:
    """Groups in order: those with a sure total first, by tokens or known cost, then by key."""
    out = usage_by(usage, prices, key)
    name = F.to_json(F.array("provider", "model")) if key == "model" else F.coalesce("cwd", F.lit(""))
    rows = out.withColumn("key", name).withColumn("total", F.when(~F.col("overflow"), total_tokens()))
    value = F.col("total") if sort == "tokens" else F.when(F.col("total").isNotNull(), F.col("known"))
    rows = rows.select("key", "sessions", "total", "known", value.alias("value"))
    return placed(rows, F.col("total").isNull(), F.desc_nulls_last("value"), F.asc("key")).select("place", "key", "sessions", "total", "known")


def price_catalog(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Every model of a provider that is used or priced: sessions, fields used, and those of them without a rate."""
    rows = merged(usage, "provider", "session", "model").withColumn("bad", invalid())
    used = rows.groupBy("provider", "model").agg(F.count_distinct("provider", "session").alias("sessions"), F.max("bad").alias("invalid_usage"), *[F.coalesce(F.max(F.when(~F.col("bad"), billed(f) > 0)), F.lit(False)).alias(f"u_{f}") for f in BILLED])
    all_ = used.join(prices, ["provider", "model"], "full_outer")
    fields = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(f), f) for f in BILLED])), ",")
    seen = lambda f: F.coalesce(F.col(f"u_{f}"), F.lit(False))
    return all_.select("provider", "model", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("invalid_usage", F.lit(False)).alias("invalid_usage"), fields(seen).alias("used_fields"), fields(lambda f: seen(f) & ~_rated(f)).alias("missing_fields"))


def cost_status(has_usage: Column, overflow: Column, unknown_models: Column) -> Column:
    return F.when(~has_usage, "no_usage").when(overflow, "overflow").when(unknown_models > 0, "partial_known_only").otherwise("known")


def unique_match(rows: DataFrame, sessions: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their session where exactly one has the key; others stay without."""
    one = sessions.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    return rows.join(one, key, "left")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the first in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last in order, at the place of the first."""
    w = W.partitionBy(*key)
    rows = rows.withColumn("place", F.min(order).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(order))))
    return rows.where("_n = 1").drop("_n")


def merge_books(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Two price books as one: a rate that the other book names replaces mine, others stay.

    change tells of each provider and model whether it was added, changed, left
    the same by the other book, or kept for want of an entry there.
    """
    fields, key = list(RATES.values()), ["provider", "model"]
    a, b = mine.select(*key, F.struct(*fields).alias("a")), other.select(*key, F.struct(*fields).alias("b"))
    rates = F.struct(*[F.coalesce(F.col(f"b.{f}"), F.col(f"a.{f}")).alias(f) for f in fields])
    both = a.join(b, key, "full_outer").withColumn("p", rates)
    change = F.when(F.col("b").isNull(), "kept").when(F.col("a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("p")), "same").otherwise("changed")
    return both.withColumn("change", change).select(*key, "p.*", "change")

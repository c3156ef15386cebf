"""What leaves the engine: tables for spreadsheets, Markdown transcripts, upserts, appended history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The columns of a usage table.
USAGE_COLUMNS = ("record_type", "metric", "value", "date", "from", "to", "sessions", "recorded_days", "tokens", "known_cost_usd", "cost_status", "unknown_price_models", "delta", "percent", "complete", "note")

#: What a program may take for a formula begins with one of these, after blanks and control signs or none.
FORMULA_SIGNS = "=+-@"
LEADING = " " + "".join(map(chr, range(33))) + "\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def _runs(text: Column) -> Column:
    """Whether a spreadsheet could run a text, or drop the line break or tab it begins with."""
    begins = lambda c, signs: reduce(lambda a, b: a | b, [c.startswith(x) for x in signs])
    return begins(F.ltrim(text, F.lit(LEADING)), FORMULA_SIGNS) | begins(text, "\t\r\n")


def csv_cell(value: Column, is_text: bool = True) -> Column:
    """A quoted cell; null is nothing. A text that a spreadsheet could run as a formula gets a quote before it."""
    text = value.cast("string")
    if is_text:
        text = F.when(_runs(text), F.concat(F.lit("'"), text)).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def csv_lines(sections: Sequence[DataFrame], columns: Sequence[str] = USAGE_COLUMNS) -> DataFrame:
    """(place, line): a head with a byte order mark, then the rows of the sections in turn; lines end with CRLF.

    A section has some of the columns and may have one called place, its order.
    """
    head = sections[0].sparkSession.range(1).select(F.lit(-1).alias("section"), F.lit(0).cast("long").alias("at"), F.lit("﻿" + ",".join(f'"{c}"' for c in columns)).alias("line"))
    for k, df in enumerate(sections):
        kinds = dict(df.dtypes)
        cells = [csv_cell(F.col(f"`{c}`"), kinds[c] == "string") if c in kinds else F.lit("") for c in columns]
        at = F.col("place").cast("long") if "place" in kinds else F.lit(0).cast("long")
        head = head.unionByName(df.select(F.lit(k).alias("section"), at.alias("at"), F.concat_ws(",", *cells).alias("line")))
    return head.select(F.struct("section", "at", "line").alias("place"), F.concat("line", F.lit("\r")).alias("line"))


def write_csv(sections: Sequence[DataFrame], path: str, columns: Sequence[str] = USAGE_COLUMNS) -> None:
    """A folder of text files that are the table in their names' order; a table of any length is sorted by ranges, and AQE makes a short one a single file."""
    csv_lines(sections, columns).orderBy("place").select("line").write.mode("overwrite").text(path, lineSep="\n")


def markdown(events: DataFrame, tools: bool = False, reasoning: bool = False) -> DataFrame:
    """(session, markdown): a transcript a session; events have session, idx, role and text.

    Messages get a heading each, tool calls and thoughts a line on demand.
    """
    role, text = F.col("role"), F.trim("text")
    part = (
        F.when(role.isin("user", "assistant") & (text != ""), F.concat(F.lit("## "), F.initcap(role), F.lit("\n\n"), text))
        .when(F.lit(tools) & (role == "tool_call"), F.concat(F.lit("> tool: "), text))
        .when(F.lit(tools) & (role == "tool_result"), F.concat(F.lit("> result: "), text))
        .when(F.lit(reasoning) & (role == "reasoning") & (text != ""), F.concat(F.lit("<details>\n\n"), text, F.lit("\n\n</details>")))
    )
    told = events.select("session", "idx", part.alias("part")).where("part is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda x: x["part"]), "\n\n")
    return told.groupBy("session").agg(F.concat(body, F.lit("\n")).alias("markdown"))


def upserted(old: DataFrame, new: DataFrame, *key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with their key; of several new rows of a key the last in order."""
    last = new
    if order:
        last = new.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_nth = 1").drop("_nth")
    return old.join(last.select(*key).distinct(), list(key), "left_anti").unionByName(last)


def appended(old: DataFrame, new: DataFrame, column: str = "value") -> DataFrame:
    """old, and the lines of new that it doesn't have yet, each once."""
    more = new.select(column).where(F.trim(column) != "").distinct().join(old.select(column), column, "left_anti")
    return old.select(column).unionByName(more)


def export_sessions(sessions: DataFrame, path: str, start: int | None = None, end: int | None = None, archived: bool = False) -> None:
    """Sessions changed from start to before end as Parquet by provider; a null time is outside of every range."""
    if start is not None:
        sessions = sessions.where(F.col("updated_at") >= start)
    if end is not None:
        sessions = sessions.where(F.col("updated_at") < end)
    if not archived:
        sessions = sessions.where(~F.col("archived"))
    sessions.write.mode("overwrite").partitionBy("provider").parquet(path)

"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAY = 86_400
#: The largest integer that a JavaScript number holds exactly; sums beyond it are flagged.
SAFE = 9_007_199_254_740_991


def ascii_lower(text: Column) -> Column:
    """A-Z folded, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1_000_000)).cast("long")


def day_of(seconds: Column) -> Column:
    return F.floor(seconds / DAY)


def day_start(seconds: Column) -> Column:
    return (day_of(seconds) * DAY).cast("long")


def week_start(seconds: Column) -> Column:
    """Start of the Monday week; day 0 was a Thursday."""
    day = day_of(seconds)
    return ((day - F.pmod(day + 3, F.lit(7))) * DAY).cast("long")


def weekday(seconds: Column) -> Column:
    """0 for Sunday."""
    return F.pmod(day_of(seconds) + 4, F.lit(7)).cast("int")


def hour_of(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(DAY)) / 3600).cast("int")


def iso_date(seconds: Column) -> Column:
    """YYYY-MM-DD in UTC; null outside the years 0 to 9999."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), day_of(seconds).cast("int"))
    return F.when(F.year(date).between(0, 9999), F.date_format(date, "yyyy-MM-dd"))


def heuristic_seconds(number: Column) -> Column:
    """Seconds from a number that is milliseconds if it is above 1e12."""
    return F.floor(F.when(number > 1e12, number / 1000).otherwise(number)).cast("long")


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def squeezed(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def clipped(text: Column, size: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def human_bytes(n: Column) -> Column:
    """0 B, 1023 B, 1.5 KB, 150 MB: one decimal below a hundred of a unit above bytes."""
    v = n.cast("double")
    out = F.concat(F.format_string("%.0f", v), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = v / 1024.0**k
        out = F.when(x >= 1, F.concat(F.when(x >= 100, F.format_string("%.0f", x)).otherwise(F.format_string("%.1f", x)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(v > 0, out).otherwise("0 B")


def human_tokens(n: Column) -> Column:
    """999, 1.2K, 3.4M, 5.6B."""
    out = n.cast("string")
    for k, unit in enumerate("KMB", 1):
        out = F.when(n >= 1000**k, F.concat(F.format_string("%.1f", n.cast("double") / 1000.0**k), F.lit(unit))).otherwise(out)
    return out


def identity_path(path: Column, windows: bool = False) -> Column:
    """A path for comparison: forward slashes, none doubled or trailing; in lower case on Windows."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "(?<!^)/{2,}", "/"), "(?<=.)/+$", "")
    return F.lower(out) if windows else out


def session_identity(provider: Column, path: Column, id_: Column, windows: bool = False) -> Column:
    """provider and path name a session; the id does without a path, and for providers of one shared file."""
    by_id = F.concat(provider, F.lit(":id:"), id_)
    return F.when(provider.isin("opencode") | F.coalesce(F.trim(path) == "", F.lit(True)), by_id).otherwise(F.concat(provider, F.lit(":"), identity_path(path, windows)))

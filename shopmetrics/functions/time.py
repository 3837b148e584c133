"""Calendar helpers.

Timestamps may arrive as ``TIMESTAMP_NTZ`` (what the Parquet test tables
hold) or as session-zone ``TIMESTAMP``. ``date_trunc`` on an NTZ value goes
through the session time zone and returns a zoned timestamp, so NTZ columns
are truncated by rebuilding the value from its own fields instead, which
needs no zone at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

GRAINS = ("year", "quarter", "month", "week", "day", "hour")


def _is_ntz(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, TimestampNTZType)


def period_start(df: DataFrame, col: str, grain: str = "month") -> Column:
    """Start of the ``grain`` period holding ``df[col]``, same type as the column."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    c = F.col(col)
    if not _is_ntz(df, col):
        return F.date_trunc(grain, c)
    if grain == "hour":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))
    if grain == "day":
        return F.to_date(c).cast("timestamp_ntz")
    return F.trunc(F.to_date(c), grain).cast("timestamp_ntz")


def period_text(c: Column | str, grain: str = "month") -> Column:
    """Period as text: ``yyyy-MM`` for months (the export format), ISO-like otherwise.

    Built from the value's own fields: ``date_format`` would take a value
    without a zone through the session's, where an hour may be missing.
    """
    c = F.col(c) if isinstance(c, str) else c
    year = F.when(F.year(c).between(0, 9999), F.lpad(F.year(c).cast("string"), 4, "0")).otherwise(F.year(c).cast("string"))

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    parts = {"year": [year], "quarter": [year, F.lit("-"), two(F.month(c))],
             "day": [year, F.lit("-"), two(F.month(c)), F.lit("-"), two(F.dayofmonth(c))]}
    parts |= {"month": parts["quarter"], "week": parts["day"],
              "hour": [*parts["day"], F.lit(" "), two(F.hour(c)), F.lit(":00")]}
    return F.concat(*parts[grain])


def month_offset(later: Column | str, earlier: Column | str) -> Column:
    """Calendar months from ``earlier`` to ``later`` (Jan 31 -> Mar 15 is 2).

    Not ``months_between`` (fractional) nor ``timestampdiff`` (whole elapsed
    months): both give 1 for that pair.
    """
    a = F.col(later) if isinstance(later, str) else later
    b = F.col(earlier) if isinstance(earlier, str) else earlier
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("int")

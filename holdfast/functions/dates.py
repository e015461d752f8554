"""Date and timestamp expressions on wall-clock time (TIMESTAMP_NTZ), independent of the session zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layouts with their three numbers in year-month-day order as the replacement. A day comes before the
# month where the middle number can be a month; only otherwise the first number is the month.
_DAY_FIRST = r"^(\d{1,2})([-/])(0?[1-9]|1[0-2])\2(\d{4})"
_MONTH_FIRST = r"^(0?[1-9]|1[0-2])([-/])(\d{1,2})\2(\d{4})"
_YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})"
DATE_LAYOUTS = [
    (_YEAR_FIRST + "$", "$1-$3-$4"),
    (_DAY_FIRST + "$", "$4-$3-$1"),
    (_MONTH_FIRST + "$", "$4-$1-$3"),
]
_CLOCK = r"(\d{1,2}:\d{1,2}:\d{1,2})$"
DATETIME_LAYOUTS = [
    # ISO: an offset or fraction is left out, an hour alone gets its minutes.
    (r"^(\d{4}-\d{2}-\d{2})$", "$1 00:00:00"),
    (r"^(\d{4}-\d{2}-\d{2}).(\d{2})(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?$", "$1 $2:00:00"),
    (r"^(\d{4}-\d{2}-\d{2}).(\d{2}:\d{2}(?::\d{2})?)(?:[.,]\d+)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?$", "$1 $2"),
    # One-digit fields. Seconds are optional and a T may stand for the blank only after dashes.
    (r"^(\d{4}-\d{1,2}-\d{1,2})[ T](\d{1,2}:\d{1,2}(?::\d{1,2})?)$", "$1 $2"),
    (_YEAR_FIRST.replace("[-/]", "/") + " " + _CLOCK, "$1-$3-$4 $5"),
    (_DAY_FIRST.replace("[-/]", "/") + " " + _CLOCK, "$4-$3-$1 $5"),
    (_MONTH_FIRST.replace("[-/]", "/") + " " + _CLOCK, "$4-$1-$3 $5"),
]


def as_date(value: str | dt.date) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def cutoff_of(asof: str | dt.date) -> dt.date:
    """Features look at history up to the day before the as-of date."""
    return as_date(asof) - dt.timedelta(days=1)


def midnight(df: DataFrame, column: str, day: dt.date) -> Column:
    """Literal for 00:00 of a day in the type of a column, so that the comparison reaches the scan."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.lit(day)
    if isinstance(kind, T.TimestampType):
        return F.to_timestamp(F.lit(day.isoformat()))
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def _rearranged(c: Column, layouts: list[tuple[str, str]]) -> Column:
    """The text in year-month-day order by the first layout that fits, or NULL."""
    out = None
    for pattern, order in layouts:
        text = F.regexp_replace(c, pattern, order)
        out = F.when(c.rlike(pattern), text) if out is None else out.when(c.rlike(pattern), text)
    # One look at the first characters spares all other text the layouts.
    return F.when(c.rlike(r"^\d{1,4}[-/]"), out)


def parse_date(c: Column) -> Column:
    """Date from six layouts: year first, else day before month, else month before day; else NULL."""
    return _rearranged(c, DATE_LAYOUTS).try_cast("date")


def parse_datetime(c: Column) -> Column:
    """Timestamp without zone, to the second, from ISO text or layouts with one-digit fields; else NULL.

    An offset is dropped and the wall clock kept.
    """
    return _rearranged(c, DATETIME_LAYOUTS).try_cast("timestamp_ntz")


def lenient_timestamp(df: DataFrame, column: str) -> Column:
    """Timestamp without zone, NULL where the text is no date."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        plain = F.when(c.rlike(r"^\s*[+-]?\d"), c.try_cast("timestamp_ntz"))
        text = F.trim(c)
        return F.coalesce(plain, parse_datetime(text), parse_date(text).cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def whole_days(until: dt.date, since: Column) -> Column:
    """Floor of (midnight of a day - timestamp) in days: an unfinished day does not count."""
    started = F.when(since > since.cast("date").cast("timestamp_ntz"), 1).otherwise(0)
    return F.datediff(F.lit(until), since.cast("date")) - started

"""Time expressions over TIMESTAMP_NTZ."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Accepted spellings of a timestamp, day first, ISO forms last.
DAY_FIRST_FORMATS = (
    "d/M/yyyy H:mm",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy",
    "d-M-yyyy H:mm",
    "d-M-yyyy H:mm:ss",
    "d-M-yyyy",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d H:mm",
    "yyyy-M-d",
)


def parse_dayfirst(c: Column) -> Column:
    """Day-first parse; null if no spelling fits, so that callers can set such rows aside."""
    text = F.regexp_replace(F.trim(c), "(?<=[0-9])T(?=[0-9])", " ")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DAY_FIRST_FORMATS]).cast("timestamp_ntz")


def parse_dayfirst_literal(text: str | dt.datetime) -> dt.datetime:
    """The same parse for a setting."""
    if isinstance(text, dt.datetime):
        return text
    text = text.strip().replace("T", " ")
    for pattern in ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d"):
        for clock in (" %H:%M", " %H:%M:%S", ""):
            try:
                return dt.datetime.strptime(text, pattern + clock)
            except ValueError:
                continue
    raise ValueError(f"not a timestamp: {text!r}")


def ntz(value: dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def is_leap_year(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def leap(year: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29


def is_feb29(ts: Column) -> Column:
    return (F.month(ts) == 2) & (F.dayofmonth(ts) == 29)


def is_feb28(ts: Column) -> Column:
    return (F.month(ts) == 2) & (F.dayofmonth(ts) == 28)


def has_feb29(df: DataFrame, column: str = "snapshot") -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(is_feb29(F.col(column))), F.lit(False)).alias("has_feb29"))


def replace_date(ts: Column, year: int, day: Column | None = None) -> Column:
    """The same clock time in another year; null where that day does not exist."""
    return F.try_make_timestamp_ntz(
        F.lit(year),
        F.month(ts),
        F.dayofmonth(ts) if day is None else day,
        F.hour(ts),
        F.minute(ts),
        F.extract(F.lit("SECOND"), ts),
    )


def in_year(ts: Column, year: int) -> Column:
    """A range on the column itself, so that Parquet row groups can be skipped."""
    return (ts >= ntz(dt.datetime(year, 1, 1))) & (ts < ntz(dt.datetime(year + 1, 1, 1)))


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def bucket_start(ts: Column, anchor: Column, hours: int) -> Column:
    """Start of the `hours`-wide bucket, counted from the midnight before the first snapshot."""
    index = F.floor(seconds_between(anchor, ts) / F.lit(hours * 3600))
    return F.timestamp_add("HOUR", (index * hours).cast("int"), anchor)

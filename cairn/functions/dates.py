"""Dates as day numbers, decimal years and parsed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two dates closer than this many days count as the same date.
SAME_DATE_DAYS = 1.0e-4


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01 with the time of day as a fraction; free of the session time zone."""
    return (
        F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double")
        + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(86400.0)
    )


def decimal_year(ts: Column) -> Column:
    start = F.trunc(F.to_date(ts), "year")
    length = F.datediff(F.add_months(start, 12), start)
    return F.year(ts) + (day_number(ts) - day_number(start.cast("timestamp_ntz"))) / length


def from_decimal_year(years: Column) -> Column:
    """Day number of a decimal year."""
    y0 = F.floor(years).cast("int")
    d0 = F.datediff(F.make_date(y0, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date"))
    d1 = F.datediff(F.make_date(y0 + 1, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date"))
    return d0 + (d1 - d0) * (years - y0)


def same_date(a: Column, b: Column) -> Column:
    return F.abs(a - b) < F.lit(SAME_DATE_DAYS)


def parse_date(text: Column, now: Column | None = None) -> Column:
    """Day number of ``Y-M-D [h:m:s]``, ``D-M-Y [h:m:s]``, a decimal year or ``now``; NULL when unreadable.

    Months may be numbers or names, and any punctuation, or none between letters and digits, separates the parts.
    """
    t = F.trim(text)
    spaced = F.regexp_replace(t, r"[^0-9A-Za-z]+|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")
    tidy = F.initcap(F.trim(F.regexp_replace(spaced, r"([A-Za-z]{3})[A-Za-z]+", "$1")))
    parts = F.split(tidy, " ")
    head = F.array_join(F.slice(parts, 1, 3), " ")
    name_second = head.rlike("[A-Za-z]")
    year_first = head.rlike(r"^[0-9]{4} ")
    date = F.coalesce(
        F.when(year_first & ~name_second, F.try_to_date(head, "y M d")),
        F.when(year_first & name_second, F.try_to_date(head, "y MMM d")),
        F.when(~year_first & name_second, F.try_to_date(head, "d MMM y")),
        F.when(~year_first & ~name_second, F.try_to_date(head, "d M y")),
    )
    clock = F.slice(parts, 4, 3)
    hms = F.aggregate(
        F.zip_with(clock, F.array(F.lit(3600), F.lit(60), F.lit(1)), lambda c, w: F.coalesce(c.try_cast("int"), F.lit(0)) * w),
        F.lit(0),
        lambda total, v: total + F.coalesce(v, F.lit(0)),
    )
    by_parts = F.when(
        F.year(date).between(1000, 4000), F.datediff(date, F.lit("1970-01-01").cast("date")) + hms / F.lit(86400.0)
    )
    number = F.when(t.rlike(r"^[0-9]{4}([.][0-9]*)?$"), t.try_cast("double"))
    by_year = F.when((number > 1000) & (number < 4000), from_decimal_year(number))
    stamp = F.when(F.lower(t) == "now", now if now is not None else day_number(F.localtimestamp()))
    return F.coalesce(stamp, by_year, by_parts)


def parse_year_day(text: Column) -> Column:
    """Day number of year and day-of-year text such as ``2003.045`` or ``2003:045``; NULL when unreadable."""
    pattern = r"^\s*(\d{4})\D+(\d{1,3})\s*$"
    year = F.regexp_extract(text, pattern, 1).try_cast("int")
    day = F.regexp_extract(text, pattern, 2).try_cast("int")
    jan1 = F.to_date(F.try_make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.when(
        year.between(1000, 4000) & day.between(1, 366),
        (F.datediff(jan1, F.lit("1970-01-01").cast("date")) + day - 1).cast("double"),
    )

"""Dates: evaluation windows and the formats that sources use."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_of(years: float) -> int:
    """Days of a number of years, half days to even."""
    return round(365.25 * years)


def years_before(day: date, years: float) -> date:
    return day - timedelta(days=days_of(years))


def age_years(snapshot: Column, first: Column) -> Column:
    return F.round(F.datediff(snapshot, first) / 365.25, 3)


def months_between(a: Column, b: Column) -> Column:
    """Calendar months from a to b, at least one."""
    return F.greatest(F.lit(1), (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a))


def date_prefix(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD at the start, missing parts as 01; NULL for others."""
    part = lambda k: F.regexp_extract(text, r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", k)
    joined = F.concat_ws("-", part(1), F.when(part(2) == "", "01").otherwise(part(2)), F.when(part(3) == "", "01").otherwise(part(3)))
    return F.try_to_date(joined, "yyyy-MM-dd")


def compact_date(text: Column) -> Column:
    """YYYY, YYYYMM or YYYYMMDD, with dashes or without; missing parts are 01."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d{4})(?:-?(\d{2}))?(?:-?(\d{2}))?", k)
    either = lambda k: F.when(part(k) == "", "01").otherwise(part(k))
    return F.try_to_date(F.concat_ws("-", part(1), either(2), either(3)), "yyyy-MM-dd")


def rss_date(text: Column) -> Column:
    """The day in UTC of an RFC 822 date, with or without weekday."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    named = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.to_date(F.to_utc_timestamp(F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss Z")), F.current_timezone()))


def iso_date(text: Column) -> Column:
    """The first of several known formats that reads; NULL if none."""
    return F.coalesce(date_prefix(text), F.try_to_date(text, "MM/dd/yyyy"), F.try_to_date(text, "dd.MM.yyyy"), F.try_to_date(text, "MMM d, yyyy"), F.try_to_date(text, "d MMM yyyy"), rss_date(text))


def epoch_ms_day(ms: Column, zone: str = "UTC") -> Column:
    """The day, in a time zone, of milliseconds since 1970."""
    days = F.timestamp_millis(ms)
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(days, F.current_timezone()), zone))

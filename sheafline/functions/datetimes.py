"""Dates, times and durations of three kinds that don't mix."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, guarded

# The display mini-language (component, padding or form) -> Java pattern.
COMPONENTS = {
    ("year", ""): "yyyy", ("year", "last_two"): "yy",
    ("month", ""): "MM", ("month", "short"): "MMM", ("month", "long"): "MMMM", ("month", "none"): "M",
    ("day", ""): "dd", ("day", "none"): "d",
    ("hour", ""): "HH", ("hour", "none"): "H", ("hour", "12"): "hh",
    ("minute", ""): "mm", ("minute", "none"): "m",
    ("second", ""): "ss", ("second", "none"): "s",
    ("period", ""): "a", ("ordinal", ""): "DDD", ("ordinal", "none"): "D",
    ("weekday", ""): "EEEE", ("weekday", "short"): "EEE", ("weekday", "long"): "EEEE",
}


def date(year: Column | int, month: Column | int, day: Column | int) -> Column:
    """An error for parts that make no date."""
    return F.make_date(*map(col, (year, month, day)))


def datetime(year: Column | int, month: Column | int, day: Column | int, hour: Column | int, minute: Column | int, second: Column | int) -> Column:
    return F.make_timestamp_ntz(*map(col, (year, month, day, hour, minute, second)))


def today(value: str | None = None, offset_hours: int | None = None) -> Column:
    """The current date, shifted to an offset from UTC; a given date makes runs repeatable."""
    if value is not None:
        return F.lit(value).cast("date")
    if offset_hours is None:
        return F.current_date()
    return F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) + F.make_dt_interval(F.lit(0), F.lit(offset_hours)))


def java_pattern(pattern: str) -> str:
    """The bracket grammar as a Java pattern; other text is quoted."""
    out, at = [], 0
    quote = lambda s: "'" + s.replace("'", "''") + "'" if s else ""
    for m in re.finditer(r"\[(\w+)((?:\s+\w+:\w+)*)\]", pattern):
        out.append(quote(pattern[at : m.start()]))
        options = dict(o.split(":") for o in m[2].split())
        form = options.get("repr", options.get("padding", ""))
        form = {"zero": "", "numerical": "", "full": "", "24": ""}.get(form, form)
        if (m[1], form) not in COMPONENTS:
            raise ValueError(f"unknown component: {m[0]}")
        out.append(COMPONENTS[m[1], form])
        at = m.end()
    return "".join([*out, quote(pattern[at:])])


def display(x: Column, pattern: str = "[year]-[month]-[day]") -> Column:
    return F.date_format(x, java_pattern(pattern))


year, month, day = F.year, F.month, F.dayofmonth
hour, minute, second, ordinal = F.hour, F.minute, F.second, F.dayofyear


def weekday(x: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(x) + 1


def duration(seconds: Column | int = 0, minutes: Column | int = 0, hours: Column | int = 0, days: Column | int = 0, weeks: Column | int = 0) -> Column:
    return F.make_dt_interval(col(days) + 7 * col(weeks), col(hours), col(minutes), col(seconds))


def seconds(d: Column) -> Column:
    """The whole duration in seconds (double)."""
    part = lambda what: F.extract(F.lit(what), d)
    return (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("double")


def minutes(d: Column) -> Column:
    return seconds(d) / 60


def hours(d: Column) -> Column:
    return seconds(d) / 3600


def days(d: Column) -> Column:
    return seconds(d) / 86400


def weeks(d: Column) -> Column:
    return seconds(d) / 604800


def difference(a: Column, b: Column) -> Column:
    """The duration from b to a, both of one kind."""
    return a - b


def shifted(x: Column, d: Column) -> Column:
    """A date or datetime moved by a duration, as a datetime."""
    return x.cast("timestamp_ntz") + d


def date_or_error(x: Column) -> Column:
    """A datetime at midnight as a date, else an error."""
    return guarded(F.to_date(x), F.date_trunc("day", x) != x, "expected a date")

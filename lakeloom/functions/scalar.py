"""Scalar functions whose rules differ from Spark's own.

Times are epoch seconds in UTC where a number is given; timestamps are taken as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def _seconds(ts: Column) -> Column:
    """Epoch seconds; a time without zone counts as UTC where the session's zone is UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def trim(s: Column) -> Column:
    """Without blanks, tabs and line ends on both sides."""
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def concat(*parts: Column) -> Column:
    """NULL if any part is; numbers become text."""
    return F.concat(*[p.cast("string") for p in parts])


def divide(a: Column, b: Column) -> Column:
    """True division; by zero NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def integer_divide(a: Column, b: Column) -> Column:
    """Truncating division of whole numbers; by zero NULL."""
    return F.when(b != 0, F.call_function("div", a.cast("long"), F.when(b != 0, b.cast("long"))))


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "dayofyear": F.dayofyear, "doy": F.dayofyear}


def date_part(part: str, ts: Column) -> Column:
    """Weeks count from 1 January (not ISO); days of the week from Sunday = 0; milliseconds are 0."""
    part = part.lower()
    if part in ("dayofweek", "dow"):
        return F.dayofweek(ts) - 1
    if part == "week":
        return F.floor((F.dayofyear(ts) - 1) / 7).cast("int") + 1
    if part in ("millisecond", "milliseconds"):
        return F.lit(0)
    return _PARTS[part](ts) if part in _PARTS else F.lit(None).cast("int")


def date_trunc(part: str, ts: Column) -> Column:
    return F.date_trunc(part, ts) if part.lower() in ("year", "month", "day", "hour", "minute", "second") else F.lit(None).cast("timestamp")


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def date_add(ts: Column, n, part: str) -> Column:
    """Months and years do not clamp: 31 January and one month is 2 or 3 March."""
    n = n if isinstance(n, Column) else F.lit(n)
    part = part.lower()
    if part in ("month", "year"):
        months = n if part == "month" else n * 12
        first = F.date_trunc("month", ts)
        moved = F.add_months(first.cast("date"), months).cast("timestamp")
        return F.timestamp_seconds(_seconds(moved) + _seconds(ts) - _seconds(first))
    return F.timestamp_seconds(_seconds(ts) + n * _SECONDS[part])


def date_diff(a: Column, b: Column, part: str) -> Column:
    """a - b: years and months by calendar fields, the others by whole units, rounded down."""
    part = part.lower()
    if part == "year":
        return (F.year(a) - F.year(b)).cast("long")
    if part == "month":
        return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("long")
    return F.floor((_seconds(a) - _seconds(b)) / _SECONDS[part])


def epoch(ts: Column) -> Column:
    return _seconds(ts)

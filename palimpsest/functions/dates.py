"""Dates as the archive's pages write them; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English months.
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _month_number(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, month in enumerate(_MONTHS, 1):
        out = F.when(F.lower(name) == month.lower(), f"{k:02d}").otherwise(out)
    return out


def _checked(year: Column, month: Column, day: Column) -> Column:
    """A date, null where the parts are none."""
    return F.try_to_date(F.concat_ws("-", F.when(year != "", year), month, F.lpad(day, 2, "0")), "yyyy-MM-dd")


def post_date(s: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` or ``MMMM d yyyy, HH:mm``; null for others."""
    part = lambda k: F.regexp_extract(s, r"^([A-Za-z]+) (\d{1,2}) (\d{4}), (\d{2}:\d{2})$", k)
    words = F.concat(part(3), F.lit("-"), _month_number(part(1)), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit(" "), part(4), F.lit(":00"))
    plain = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), s)
    return F.try_to_timestamp(F.coalesce(plain, words), F.lit("yyyy-MM-dd HH:mm:ss"))


def wall_date(s: Column) -> Column:
    """Local date of ``d MMMM uuuu, HH:mm <zone>``; the zone does not shift it, and must be there."""
    part = lambda k: F.regexp_extract(s, r"^(\d{1,2}) ([A-Za-z]+) (\d{4}), ([01]\d|2[0-3]):[0-5]\d (\S+)$", k)
    return _checked(part(3), _month_number(part(2)), part(1))


def dotted_date(s: Column) -> Column:
    """``dd.MM.yyyy`` at the start, blanks and no-break spaces around it; null if it is no date."""
    part = lambda k: F.regexp_extract(s, "^[ \\t\u00a0]*(\\d{2})\\.(\\d{2})\\.(\\d{4})(?=[ \\t\u00a0]|$)", k)
    return _checked(part(3), F.when(part(2) != "", part(2)), part(1))


def header_time(s: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in a header cell, as UTC."""
    return F.try_to_timestamp(F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm"))


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def from_stamp(s: Column) -> Column:
    """The time of an archive stamp of 14 digits; null for others."""
    return F.when(s.rlike("^[0-9]{14}$"), F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss")))


def in_range(year: Column, month: Column, first: tuple[int, int] | None, last: tuple[int, int] | None) -> Column:
    """Inclusive year-month range; a bound may be absent."""
    at, out = year * 12 + month, F.lit(True)
    if first:
        out &= at >= first[0] * 12 + first[1]
    if last:
        out &= at <= last[0] * 12 + last[1]
    return out

"""Column expressions shared by the operators.

All of them are JVM-side built-ins and safe under ANSI mode: dirty input becomes null,
it never raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_SECONDS = 3600


def published_date(stamp: str = "DATEADDED") -> Column:
    """Leading ``YYYYMMDD`` of a compact time stamp, as int."""
    return F.substring(F.col(stamp), 1, 8).try_cast("int")


def is_conflict(min_quad: int = 3) -> Column:
    """Quad classes 1-2 are cooperation, 3-4 conflict."""
    return F.col("QuadClass") >= min_quad


def filled(name: str) -> Column:
    """Neither null nor the empty string."""
    return F.col(name).isNotNull() & (F.col(name) != "")


def stamp_number(stamp: str) -> Column:
    """``YYYYMMDDHHMMSS`` text as a number, null for text of any other shape.

    Cheap enough for every raw row, and a compact grouping key; ``wall_clock`` then reads
    the calendar on the far fewer grouped rows.
    """
    text = F.col(stamp)
    return F.when((F.length(text) == 14) & (text >= "1"), text.try_cast("bigint"))


def hour_number(number: Column) -> Column:
    """Stamp number of the start of its hour, null when minutes or seconds are out of range."""
    clock = number % 10_000
    return F.when((clock < 6000) & (clock % 100 < 60), number - clock)


def wall_clock(number: Column) -> Column:
    """Stamp number as a zone-free timestamp, null when there is no such time.

    A parse into the session's zone would shift or drop hours where that zone has daylight
    saving.
    """
    iso = number.cast("string")
    for position, separator in ((5, "-"), (8, "-"), (11, " "), (14, ":"), (17, ":")):
        iso = F.overlay(iso, F.lit(separator), position, 0)
    return F.when(number >= 10**13, iso.try_cast("timestamp_ntz"))


def calendar_day(number: str) -> Column:
    """``YYYYMMDD`` int as a date, null when there is no such day."""
    return F.try_to_date(F.col(number).cast("string"), "yyyyMMdd")


def first_item(text: Column, separator: str) -> Column:
    """Part of ``text`` before the first separator, the whole text when there is none."""
    return F.substring_index(text, separator, 1)

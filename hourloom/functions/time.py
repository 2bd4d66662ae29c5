"""Columns over naive wall-clock times (TIMESTAMP_NTZ); the session's zone is UTC and serves as a neutral axis."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def epoch_seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("long")


def monday_weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def inside(c: Column, start: str, end: str) -> Column:
    """Half-open: start <= c < end."""
    if not start < end:
        raise ValueError("an interval must start before it ends")
    return (c >= ntz(start)) & (c < ntz(end))


def us_clock_changes(year: int) -> list[date]:
    """Second Sunday of March and first Sunday of November."""
    if year < 2007:
        raise ValueError("the rule holds from 2007")
    march, november = date(year, 3, 8), date(year, 11, 1)
    return [d + timedelta((6 - d.weekday()) % 7) for d in (march, november)]


def clock_change(year: Column, spring: bool) -> Column:
    """Midnight of the second Sunday of March or the first of November of a year from 2007 on."""
    first = F.make_date(year.cast("int"), F.lit(3 if spring else 11), F.lit(1))
    sunday = F.next_day(F.date_sub(first, 1), "Sun")
    day = F.date_add(sunday, 7 if spring else 0).cast("timestamp_ntz")
    return F.when(year < 2007, F.raise_error(F.lit("the rule holds from 2007")).cast("timestamp_ntz")).otherwise(day)


def masked_day(c: Column, days: tuple[str, ...]) -> Column:
    return F.to_date(c).isin([F.to_date(F.lit(d)) for d in days]) if days else F.lit(False)

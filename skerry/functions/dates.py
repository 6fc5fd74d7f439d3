"""Date and time expressions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = str | dt.date


def as_date(value: DateLike) -> Column:
    """A literal date; a string is parsed here, at the boundary, so a typo fails early."""
    return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)


def period_start(day: Column, aggregation: str) -> Column:
    """First day of the period holding ``day``; an unknown aggregation means daily."""
    unit = {"weekly": "WEEK", "monthly": "MONTH", "yearly": "YEAR"}.get(aggregation)
    return F.trunc(day, unit) if unit else day.cast("date")


def in_years(day: Column, first: int | None = None, last: int | None = None) -> Column:
    """Calendar-year bounds written as date bounds, which reach the scan as pushed filters."""
    condition = F.lit(True)
    if first is not None:
        condition = condition & (day >= F.lit(dt.date(first, 1, 1)))
    if last is not None:
        condition = condition & (day <= F.lit(dt.date(last, 12, 31)))
    return condition


def _by_month(month: Column, seasons: Sequence[tuple[str, Sequence[int]]], otherwise: str) -> Column:
    label = F
    for name, months in seasons:
        label = label.when(month.isin(*months), name)
    return label.otherwise(otherwise)


def calendar_season(month: Column) -> Column:
    """Meteorological seasons. A null month falls in the last branch, as in the data it mirrors."""
    return _by_month(
        month,
        [("Winter", (12, 1, 2)), ("Spring", (3, 4, 5)), ("Summer", (6, 7, 8))],
        "Autumn",
    )


def ringing_season(month: Column) -> Column:
    """Seasons as a ringing station sees them: summer is June and July, autumn starts in August."""
    return _by_month(
        month,
        [("Spring", (3, 4, 5)), ("Summer", (6, 7)), ("Autumn", (8, 9, 10, 11))],
        "Winter",
    )


def migration_season(
    month: Column, spring: Sequence[int] = (3, 4, 5), autumn: Sequence[int] = (8, 9, 10)
) -> Column:
    return _by_month(month, [("spring", spring), ("autumn", autumn)], "other")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, read off its own fields so the session
    time zone plays no part."""
    whole = (
        F.unix_date(ts.cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
    ) * 1_000_000
    return whole + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def at_hour(day: Column, hours: Column) -> Column:
    """The start of the whole hour of a fractional hour-of-day, as a zone-less timestamp."""
    return _shift(day, F.floor(hours) * 60)


def at_minute(day: Column, hours: Column) -> Column:
    """As :func:`at_hour`, keeping whole minutes."""
    return _shift(day, F.floor(hours) * 60 + F.floor((hours - F.floor(hours)) * 60))


def _shift(day: Column, minutes: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))

"""Lenient parsing: a value that does not fit becomes null instead of failing the job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens public CSV readers take for a missing value.
EXPORT_NULLS = ("", "null", "NULL")
REPORT_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def nulled(value: Column, tokens: Iterable[str]) -> Column:
    return F.when(~value.isin(*tokens), value)


def trimmed(value: Column) -> Column:
    """Outer white space removed; nothing left means null."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def _shaped(value: Column, pattern: str) -> Column:
    """``value`` where it has the shape a parser expects. Parsers signal misfits by exceptions
    inside, which is slow when a column is full of them; a pattern is not."""
    return F.when(value.rlike(pattern), value)


def iso_date(value: Column) -> Column:
    """``yyyy-MM-dd`` text to a date."""
    return _shaped(value, r"^\d{4}-\d{2}-\d{2}$").try_cast("date")


def clock_time(day: Column, time: Column) -> Column:
    """``yyyy-MM-dd`` and ``HH:mm:ss`` text to a zone-less timestamp."""
    text = F.concat_ws(" ", F.trim(day), F.trim(time))
    # Fixed value: the date and time format of station exports.
    return _shaped(text, r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$").try_cast("timestamp_ntz")


def number(value: Column) -> Column:
    text = F.trim(value)
    return _shaped(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$").try_cast("double")


def whole_number(value: Column) -> Column:
    text = F.trim(value)
    return _shaped(text, r"^[+-]?\d+$").try_cast("int")


def flag(value: Column) -> Column:
    """``true`` / ``false`` in any case; everything else is null."""
    word = F.lower(F.trim(value))
    return F.when(word == "true", True).when(word == "false", False)


def offset_to_utc(value: Column) -> Column:
    """ISO-8601 text with a zone offset to a zone-less UTC timestamp.

    The offset is taken off by hand so that the session time zone plays no part.
    """
    # Fixed value: date, T, time, then Z or a signed offset with or without a colon.
    valid = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$")
    local = F.translate(F.substring(value, 1, 19), "T", " ").try_cast("timestamp_ntz")
    minutes = F.substring(value, 21, 2).try_cast("int") * 60 + F.right(
        value, F.lit(2)).try_cast("int")
    ahead = (
        F.when(F.substring(value, 20, 1) == "+", minutes)
        .when(F.substring(value, 20, 1) == "-", -minutes).otherwise(0)
    )
    return F.when(valid, local - F.make_dt_interval(mins=ahead))

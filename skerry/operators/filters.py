"""Row filters and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.dates import DateLike, as_date, in_years
from skerry.schemas import WEATHER_MEASURES, column


def between_dates(
    df: DataFrame, start: DateLike | None = None, end: DateLike | None = None, on: str = "date"
) -> DataFrame:
    """Rows inside the inclusive bounds; an empty bound is open."""
    if start:
        df = df.where(column(on) >= as_date(start))
    if end:
        df = df.where(column(on) <= as_date(end))
    return df


def of_species(
    df: DataFrame, codes: str | Sequence[str] | None, on: str = "species_code"
) -> DataFrame:
    """Rows of one or several species. None keeps all; an empty list keeps none."""
    if codes is None:
        return df
    wanted = [codes] if isinstance(codes, str) else list(codes)
    return df.where(column(on).isin(*wanted))


def of_years(
    df: DataFrame, first: int | None = None, last: int | None = None, on: str = "date"
) -> DataFrame:
    return df.where(in_years(column(on), first, last))


def select_captures(
    df: DataFrame,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
    species_codes: Sequence[str] | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """The filters every report shares. Here an empty species list means all species."""
    df = between_dates(df, start_date, end_date)
    df = of_years(df, start_year, end_year) if start_year or end_year else df
    return of_species(df, species_codes) if species_codes else df


def positive(measure: str) -> Column:
    """A usable measurement: present and above zero."""
    return column(measure) > 0


def valid_fat(measure: str = "fat_score") -> Column:
    return column(measure).between(0, 10)


def filled(name: str) -> Column:
    """Neither null nor the empty string."""
    return column(name) != ""


def matching(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """``{column: value or list of values}`` combined with AND."""
    for name, wanted in (filters or {}).items():
        many = isinstance(wanted, (list, tuple, set))
        df = df.where(column(name).isin(*wanted) if many else column(name) == F.lit(wanted))
    return df


def in_hours(df: DataFrame, first: int = 3, last: int = 13, on: str = "observation_time"):
    """Rows whose hour of day lies in ``first..last``; the default is the ringing window."""
    return df.where(F.hour(column(on)).between(first, last))


def since(df: DataFrame, day: DateLike = "1980-01-01", on: str = "observation_time") -> DataFrame:
    """Rows from the cut-off on; the default is the start of the historic weather archive."""
    return df.where(column(on) >= as_date(day).cast("timestamp_ntz"))


def null_if_stale(
    df: DataFrame,
    max_gap_hours: float,
    gap: str = "weather_match_hours",
    columns: Sequence[str] = tuple(WEATHER_MEASURES),
) -> DataFrame:
    """Keep the rows, but only trust ``columns`` where the match is at most this old."""
    fresh = column(gap) <= max_gap_hours
    return df.withColumns({name: F.when(fresh, column(name)) for name in columns})


def rename_and_order(
    df: DataFrame, renames: Mapping[str, str] | None = None, first: Sequence[str] = (),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Rename, drop, then move ``first`` to the front."""
    df = df.withColumnsRenamed(dict(renames or {})).drop(*drop)
    rest = [name for name in df.columns if name not in first]
    return df.select(*[column(name) for name in [*first, *rest]])

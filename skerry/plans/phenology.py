"""When species pass: counts over the year, migration windows, peak days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.dates import DateLike, migration_season
from skerry.operators.distribution import QUARTILES, distribution
from skerry.operators.filters import select_captures
from skerry.operators.joins import keep_top_groups
from skerry.plans.captures import add_time_features, rows
from skerry.schemas import column

SPECIES = ("species_code", "swedish_name")


def _dated(
    df: DataFrame, species_codes: Sequence[str] | None, start_year: int | None,
    end_year: int | None,
) -> DataFrame:
    """Selected captures with year, month, ISO week and day of year. The year is the calendar
    year also next to the ISO week, so a day in early January may be in week 52 or 53."""
    chosen = select_captures(
        df, species_codes=species_codes, start_year=start_year, end_year=end_year)
    return chosen.where(F.col("date").isNotNull()).withColumns({
        "year": F.year("date"), "month": F.month("date"),
        "week_of_year": F.weekofyear("date"), "day_of_year": F.dayofyear("date"),
    })


def _counts_over_year(df: DataFrame, unit: str, aggregate_years: bool) -> DataFrame:
    yearly = df.groupBy(*SPECIES, "year", unit).agg(rows().alias("count"))
    if not aggregate_years:
        return yearly.orderBy("species_code", "year", unit)
    # One row per year is left, so counting rows counts the years.
    return yearly.groupBy(*SPECIES, unit).agg(
        F.sum("count").alias("total_count"),
        F.avg("count").alias("avg_count"),
        F.stddev_samp("count").alias("std_count"),
        F.count("year").alias("n_years"),
    ).orderBy("species_code", unit)


def phenology_daily(
    df: DataFrame, species_codes: Sequence[str] | None = None, start_year: int | None = None,
    end_year: int | None = None, aggregate_years: bool = True,
) -> DataFrame:
    """Captures per species and day of year: per year, or summed up over the years with data."""
    dated = _dated(df, species_codes, start_year, end_year)
    return _counts_over_year(dated, "day_of_year", aggregate_years)


def phenology_weekly(
    df: DataFrame, species_codes: Sequence[str] | None = None, start_year: int | None = None,
    end_year: int | None = None, aggregate_years: bool = True,
) -> DataFrame:
    """As :func:`phenology_daily` by ISO week."""
    dated = _dated(df, species_codes, start_year, end_year)
    return _counts_over_year(dated, "week_of_year", aggregate_years)


def in_years_of(
    report, df: DataFrame, species_codes: Sequence[str], start_date: DateLike,
    end_date: DateLike, **options: object,
) -> DataFrame:
    """A report of this module for a selection of dates, of which only the years count."""
    first, last = (int(str(day)[:4]) for day in (start_date, end_date))
    return report(df, species_codes, first, last, **options)


def phenology_by_species(
    df: DataFrame, species_codes: Sequence[str] | None = None, start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """First, last and quartile days (discrete) of each species and year."""
    dated = _dated(df, species_codes, start_year, end_year)
    stats = distribution(dated, "day_of_year", [*SPECIES, "year"], bounded=True)
    names = {
        "min": "first", "q25": "q25", "median": "median", "q75": "q75", "max": "last",
    }
    return stats.select(
        *SPECIES, "year",
        *[F.col(k).cast("int").alias(f"{v}_day_of_year") for k, v in names.items()],
        F.col("n").alias("n_observations"),
    ).orderBy("species_code", "year")


def migration_windows(
    df: DataFrame, species_codes: Sequence[str] | None = None, start_year: int | None = None,
    end_year: int | None = None, spring_months: Sequence[int] = (3, 4, 5),
    autumn_months: Sequence[int] = (8, 9, 10),
) -> DataFrame:
    """First, last and quartile days of each species, year and migration season."""
    dated = _dated(df, species_codes, start_year, end_year)
    season = migration_season(F.col("month"), spring_months, autumn_months)
    moving = dated.where(F.col("month").isin(*spring_months, *autumn_months))
    stats = distribution(
        moving.withColumn("season", season), "day_of_year", [*SPECIES, "year", "season"],
        bounded=True)
    day = {k: F.col(k).cast("int") for k in ("min", "q25", "median", "q75", "max")}
    return stats.select(
        *SPECIES, "year", "season", F.col("n").alias("n_observations"),
        day["min"].alias("first_obs"), day["q25"].alias("q25"), day["median"].alias("median"),
        day["q75"].alias("q75"), day["max"].alias("last_obs"),
        (day["q75"] - day["q25"]).alias("iqr_days"),
    ).orderBy("species_code", "year", "season")


def seasonal_average(windows: DataFrame) -> DataFrame:
    """Over the years of :func:`migration_windows`: mean quartile days, their distances to the
    median, and all observations."""
    mean = windows.groupBy("swedish_name", "season").agg(
        F.avg("median").alias("median"), F.avg("q25").alias("q25"), F.avg("q75").alias("q75"),
        F.sum("n_observations").alias("n_observations"),
    )
    return mean.withColumns({
        "above_median": F.col("q75") - F.col("median"),
        "below_median": F.col("median") - F.col("q25"),
    })


def phenology_metrics(
    df: DataFrame, year: str = "year", day_of_year: str = "day_of_year"
) -> DataFrame:
    """Arrival and departure days per species and year: outer quartiles at the nearest element,
    the median interpolated. Time features are added where missing."""
    if day_of_year not in df.columns:
        df = add_time_features(df)
    quartiles = {"q25": (0.25, "nearest"), "median": (0.5, "linear"), "q75": (0.75, "nearest")}
    stats = distribution(df, day_of_year, [*SPECIES, year], quartiles, bounded=True)
    return stats.select(
        *SPECIES, column(year),
        F.col("min").cast("int").alias("first_arrival_day"),
        F.col("q25").alias("q25_arrival_day"),
        F.col("median").alias("median_arrival_day"),
        F.col("q75").alias("q75_arrival_day"),
        F.col("max").cast("int").alias("last_departure_day"),
        F.col("n").alias("n_observations"),
    ).orderBy("species_code", year)


def monthly_counts(
    df: DataFrame, species_codes: Sequence[str] | None = None, start_year: int | None = None
) -> DataFrame:
    dated = _dated(df, species_codes, start_year, None)
    return dated.groupBy(*SPECIES, "year", "month").agg(rows().alias("count")).orderBy(
        "species_code", "year", "month")


def top_months(monthly: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` busiest months of each species over all years, from :func:`monthly_counts`."""
    total = monthly.groupBy("swedish_name", "month").agg(F.sum("count").alias("total"))
    best = Window.partitionBy("swedish_name").orderBy(F.desc("total"), "month")
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def peak_day(daily: DataFrame) -> DataFrame:
    """Per species: the day of year with the highest average (the earliest such day), all
    captures, and days with captures. ``daily`` is :func:`phenology_daily` over the years."""
    best = F.min(F.struct((-F.col("avg_count")).alias("_rank"), "day_of_year"))
    return daily.groupBy("swedish_name").agg(
        best["day_of_year"].alias("peak_day"),
        F.sum("total_count").alias("total_observations"),
        rows().alias("n_days"),
    )


def species_week_matrix(weekly: DataFrame, weeks: Sequence[int] = range(1, 54)) -> DataFrame:
    """Average counts of :func:`phenology_weekly`, one row per species and one column per week."""
    return weekly.groupBy("swedish_name").pivot("week_of_year", list(weeks)).agg(
        F.max("avg_count")).fillna(0.0)


def species_trend(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Weekly counts of the most frequent species over the number of years in all the data."""
    years = df.agg(F.count_distinct(F.year("date")).alias("years")).scalar()
    weekly = df.groupBy(F.weekofyear("date").alias("week"), "swedish_name").agg(
        rows().alias("_rows"))
    return keep_top_groups(weekly, "swedish_name", top_n, "_rows").select("week", "swedish_name", (F.col("_rows") / years).alias("count"))


def seasonality_histogram(
    df: DataFrame, species_names: Sequence[str] | None = None, bins: int = 80
) -> DataFrame:
    """Captures per species and equal-width range of days of the year, at most ``bins`` ranges."""
    width = -(-366 // bins)
    first = F.floor((F.dayofyear("date") - 1) / width) * width + 1
    chosen = df if species_names is None else df.where(
        F.col("swedish_name").isin(*species_names))
    return chosen.groupBy("swedish_name", first.cast("int").alias("first_day")).agg(
        rows().alias("count"))


def species_week_density(
    df: DataFrame, species_names: Sequence[str] | None = None
) -> DataFrame:
    chosen = df if species_names is None else df.where(
        F.col("swedish_name").isin(*species_names))
    return chosen.groupBy("swedish_name", F.weekofyear("date").alias("week")).agg(
        rows().alias("count"))

"""Captures over time, by individual and by ringer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.dates import DateLike, calendar_season, period_start
from skerry.operators.distribution import distribution
from skerry.operators.filters import between_dates, filled, select_captures
from skerry.operators.joins import keep_top_groups, top_by_count
from skerry.schemas import column

def rows() -> Column:
    return F.count(F.lit(1))


def species_time_series(
    df: DataFrame, start_date: DateLike | None = None, end_date: DateLike | None = None,
    species_codes: Sequence[str] | None = None, aggregation: str = "daily",
) -> DataFrame:
    """Per period (daily, weekly, monthly, yearly) and species: captures, individuals, means."""
    chosen = select_captures(df, start_date, end_date, species_codes)
    period = period_start(F.col("date"), aggregation).alias("period")
    return chosen.groupBy(period, "species_code", "swedish_name").agg(
        rows().alias("count"),
        F.count_distinct("ring_number").alias("unique_individuals"),
        F.avg("weight").alias("mean_weight"),
        F.avg("wing_length").alias("mean_wing_length"),
    ).orderBy("period", "species_code")


def species_diversity(df: DataFrame, aggregation: str = "monthly") -> DataFrame:
    period = period_start(F.col("date"), aggregation).alias("period")
    return df.groupBy(period).agg(
        F.count_distinct("species_code").alias("species_richness"),
        rows().alias("total_observations"),
    ).orderBy("period")


def daily_diversity(
    df: DataFrame, start_date: DateLike | None = None, end_date: DateLike | None = None
) -> DataFrame:
    return between_dates(df, start_date, end_date).groupBy("date").agg(
        rows().alias("total_obs"),
        F.count_distinct("species_code").alias("n_species"),
        F.count_distinct("ring_number").alias("n_individuals"),
    ).orderBy("date")


def daily_counts(
    df: DataFrame, group_by: Sequence[str] = ("date", "species_code")
) -> DataFrame:
    return df.groupBy(*group_by).agg(
        rows().alias("count"),
        *[
            function(name).alias(f"{label}_{name}")
            for name in ("weight", "wing_length")
            for label, function in (("mean", F.avg), ("std", F.stddev_samp))
        ],
    ).orderBy(*group_by)


def daily_total(df: DataFrame) -> DataFrame:
    return df.where(F.col("date").isNotNull()).groupBy("date").agg(rows().alias("count"))


def add_time_features(df: DataFrame, date_column: str = "date") -> DataFrame:
    """Year, month, day, weekday (Monday is 1), day of year, ISO week and calendar season."""
    day = column(date_column)
    return df.withColumns({
        "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day),
        "weekday": F.weekday(day) + 1, "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day), "season": calendar_season(F.month(day)),
    })


def recapture_analysis(df: DataFrame) -> DataFrame:
    """Rings seen more than once per species, with the time between first and last capture."""
    ringed = df.where(filled("ring_number"))
    days = F.datediff("last_capture", "first_capture")
    return ringed.groupBy("ring_number", "species_code").agg(
        F.min("date").alias("first_capture"),
        F.max("date").alias("last_capture"),
        rows().alias("n_captures"),
        F.count_distinct("date").alias("n_capture_days"),
    ).where(F.col("n_captures") > 1).withColumns({
        "days_between": days, "years_between": F.round(days / F.lit(365.25), 2),
    }).orderBy(F.desc("n_captures"), F.desc("days_between"), "ring_number", "species_code")


def recapture_stats(df: DataFrame) -> DataFrame:
    """As :func:`recapture_analysis` by ring alone; the species is that of the first capture, and
    rows without a ring form one group like any other."""
    # A bird is of one species, so this hash aggregate does nearly all of the work.
    by_species = df.groupBy("ring_number", "species_code").agg(
        rows().alias("_n"), F.min("date").alias("_first"), F.max("date").alias("_last"))
    return by_species.groupBy("ring_number").agg(
        F.sum("_n").alias("n_captures"),
        F.min("_first").alias("first_capture"),
        F.max("_last").alias("last_capture"),
        F.min(F.struct("_first", "species_code"))["species_code"].alias("species_code"),
    ).where(F.col("n_captures") > 1).withColumn(
        "days_between", F.datediff("last_capture", "first_capture")
    ).orderBy(F.desc("n_captures"), "ring_number")


def ringer_statistics(
    df: DataFrame, start_date: DateLike | None = None, end_date: DateLike | None = None
) -> DataFrame:
    chosen = between_dates(df, start_date, end_date).where(filled("ringer"))
    return chosen.groupBy("ringer").agg(
        rows().alias("total_rings"),
        F.count_distinct("species_code").alias("unique_species"),
        F.count_distinct("date").alias("active_days"),
        F.min("date").alias("first_record"),
        F.max("date").alias("last_record"),
    ).orderBy(F.desc("total_rings"), "ringer")


def ringer_activity(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Captures per day of the most active ringers."""
    daily = df.groupBy("date", "ringer").agg(rows().alias("count"))
    return keep_top_groups(daily, "ringer", top_n).where(F.col("date").isNotNull()).select(
        "date", "ringer", "count")


def year_over_year(df: DataFrame, species_codes: Sequence[str] | None = None) -> DataFrame:
    """Yearly counts beside those of the previous year that has any. The window only sees one row
    per species and year."""
    yearly = select_captures(df, species_codes=species_codes).groupBy(
        "species_code", "swedish_name", F.year("date").alias("year")
    ).agg(rows().alias("count"))
    change = F.col("count") - F.col("prev_year_count")
    before = F.lag("count").over(Window.partitionBy("species_code").orderBy("year"))
    return yearly.withColumn("prev_year_count", before).withColumns({
        "absolute_change": change,
        "percent_change": F.round(
            F.lit(100.0) * change / F.nullif(F.col("prev_year_count"), F.lit(0)), 2),
    }).orderBy("species_code", "year")


def pivot_by_time(
    df: DataFrame, time_column: str = "date", value_column: str = "species_code",
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Counts with a row per time and a column per value; a pair without rows is null.

    Without ``values`` Spark looks for the distinct values first and fails above
    ``spark.sql.pivotMaxValues`` of them."""
    grouped = df.groupBy(column(time_column))
    return grouped.pivot(value_column, list(values) if values else None).agg(
        rows()).orderBy(time_column)


def yearly_description(df: DataFrame) -> DataFrame:
    """Count, mean, spread and quartiles of the number of captures per year."""
    yearly = df.groupBy(F.year("date").alias("year")).agg(rows().alias("rows")).where(
        F.col("year").isNotNull())
    # One row per year: nothing here grows with the captures.
    return distribution(yearly, "rows", (), method="linear", bounded=True)


def top_species(df: DataFrame, n: int = 10) -> DataFrame:
    return top_by_count(df, ["species_code", "swedish_name"], n)

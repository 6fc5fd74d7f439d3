"""Weather over time, and weather at the time of captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.dates import DateLike, at_hour, at_minute, period_start
from skerry.operators.asof import HOUR, asof_join
from skerry.operators.filters import between_dates, in_hours, null_if_stale, select_captures
from skerry.operators.joins import fillable, filled_from_backup, with_backup
from skerry.plans.captures import rows
from skerry.schemas import WEATHER_MEASURES

# The nine measures in the order reports list them.
MATCHED = (
    "temperature", "wind_direction", "wind_speed", "gust_wind", "humidity", "precipitation",
    "pressure", "visibility", "cloud_cover",
)
QUALITY = (
    "temperature_quality", "wind_speed_quality", "precipitation_quality", "visibility_quality",
)


def _dated(weather: DataFrame, start: DateLike | None, end: DateLike | None) -> DataFrame:
    return between_dates(
        weather.withColumn("date", F.col("observation_time").cast("date")), start, end)


def weather_hourly(
    weather: DataFrame, start_date: DateLike | None = None, end_date: DateLike | None = None
) -> DataFrame:
    """Readings as they are, with date and hour."""
    return _dated(weather, start_date, end_date).select(
        "observation_time", "date", F.hour("observation_time").alias("hour"), *MATCHED, *QUALITY
    ).orderBy("observation_time")


def _summary(precipitation, pressure, visibility) -> list:
    """Aggregates every weather report shares. Wind direction is averaged as a plain number."""
    return [
        F.avg("temperature").alias("mean_temperature"),
        F.min("temperature").alias("min_temperature"),
        F.max("temperature").alias("max_temperature"),
        F.avg("wind_speed").alias("mean_wind_speed"),
        F.max("gust_wind").alias("max_gust"),
        F.avg("wind_direction").alias("mean_wind_direction"),
        F.avg("humidity").alias("mean_humidity"),
        F.sum(precipitation).alias("total_precipitation"),
        F.avg(pressure).alias("mean_pressure"),
        F.avg(visibility).alias("mean_visibility"),
        F.avg("cloud_cover").alias("mean_cloud_cover"),
    ]


def _filled_summary() -> list:
    return _summary(*[
        filled_from_backup(name) for name in ("precipitation", "pressure", "visibility")])


def weather_by_period(
    weather: DataFrame, start_date: DateLike | None = None, end_date: DateLike | None = None,
    aggregation: str = "daily",
) -> DataFrame:
    """Readings per day, week or month."""
    unit = aggregation if aggregation in ("weekly", "monthly") else "daily"
    return _dated(weather, start_date, end_date).groupBy(
        period_start(F.col("date"), unit).alias("period")
    ).agg(
        *_summary("precipitation", "pressure", "visibility"), rows().alias("n_obs")
    ).orderBy("period")


def daily_weather_summary(
    weather: DataFrame, backup: DataFrame, start_date: DateLike | None = None,
    end_date: DateLike | None = None, flag: str = "backup_gap_fill_used",
) -> DataFrame:
    """Whole days, with rain, pressure and visibility filled from the backup station. ``flag``
    tells whether it supplied anything that day; completeness is relative to 24 readings."""
    used = fillable("precipitation") | fillable("pressure") | fillable("visibility")
    daily = with_backup(_dated(weather, start_date, end_date), backup).groupBy("date").agg(
        *_filled_summary(),
        (F.count("temperature") / F.lit(24.0)).alias("data_completeness"),
        F.bool_or(used).alias(flag),
    )
    parts = {"year": F.year("date"), "month": F.month("date"), "day_of_year": F.dayofyear("date")}
    rest = [name for name in daily.columns if name != "date"]
    return daily.select(
        "date", *[part.alias(name) for name, part in parts.items()], *rest).orderBy("date")


def weather_split(
    summary: DataFrame, from_backup: bool, flag: str = "backup_gap_fill_used"
) -> DataFrame:
    """The days of :func:`daily_weather_summary` with, or without, values from the backup."""
    return summary.where(F.col(flag) if from_backup else ~F.col(flag))


def ringing_window_weather(weather: DataFrame, backup: DataFrame) -> DataFrame:
    """Weather per day over the hours 3 to 13, when most birds are caught, filled from the backup
    station. Completeness is relative to ten readings although eleven hours count, so 1.1 is
    possible."""
    hours = in_hours(weather, 3, 13).withColumn("date", F.col("observation_time").cast("date"))
    return with_backup(hours, backup).groupBy("date").agg(
        *_filled_summary(), (F.count("temperature") / F.lit(10.0)).alias("data_completeness"))


def _ringing(chosen: DataFrame, *keys: str) -> DataFrame:
    return chosen.groupBy(*keys, "species_code", "swedish_name").agg(
        rows().alias("captures"), F.avg("weight").alias("mean_weight"),
        F.avg("fat_score").alias("mean_fat_score"),
    )


def ringing_with_daily_weather(
    captures: DataFrame, weather: DataFrame, backup: DataFrame,
    start_date: DateLike | None = None, end_date: DateLike | None = None,
    species_codes: Sequence[str] | None = None,
) -> DataFrame:
    """Captures per day and species beside that day's ringing-window weather. Both sides are
    aggregated before they meet."""
    chosen = select_captures(captures, start_date, end_date, species_codes)
    ringing = _ringing(chosen.where(F.col("date").isNotNull()), "date")
    return ringing.join(ringing_window_weather(weather, backup), "date", "left").orderBy(
        "date", "species_code")


def _matched(left: DataFrame, weather: DataFrame, decimals: int, bucket_seconds: int):
    """The as-of match of ``capture_ts`` with the reading in force, its age rounded."""
    readings = weather.select(F.col("observation_time").alias("weather_ts"), *MATCHED)
    joined = asof_join(
        left, readings, "capture_ts", "weather_ts", gap="weather_match_hours",
        bucket_seconds=bucket_seconds)
    age = F.round(F.abs("weather_match_hours"), decimals)
    return joined.withColumn("weather_match_hours", age)


def ringing_with_weather_in_force(
    captures: DataFrame, weather: DataFrame, start_date: DateLike | None = None,
    end_date: DateLike | None = None, species_codes: Sequence[str] | None = None,
    max_gap_hours: float = 2, bucket_seconds: int = HOUR,
) -> DataFrame:
    """Captures per day, whole hour and species beside the latest reading at or before the hour.
    The match looks backward only; readings older than ``max_gap_hours`` are blanked."""
    chosen = select_captures(captures, start_date, end_date, species_codes).where(
        F.col("date").isNotNull()
    ).withColumn("capture_hour", F.floor("time").cast("int"))
    groups = _ringing(chosen, "date", "capture_hour").withColumn(
        "capture_ts", at_hour(F.col("date"), F.col("capture_hour")))
    fresh = null_if_stale(_matched(groups, weather, 1, bucket_seconds), max_gap_hours)
    return fresh.select(
        "date", "capture_hour", "species_code", "swedish_name", "captures", "mean_weight",
        "mean_fat_score", "weather_ts", "weather_match_hours", *MATCHED,
    ).orderBy("date", "capture_hour", "species_code")


def weather_at_capture(
    captures: DataFrame, weather: DataFrame, start_date: DateLike | None = None,
    end_date: DateLike | None = None, species_codes: Sequence[str] | None = None,
    max_gap_hours: float = 2, bucket_seconds: int = HOUR, ordered: bool = False,
) -> DataFrame:
    """Every capture with a time beside the latest reading at or before its minute.

    One row per capture, so sorting it is a shuffle of all of them: ``ordered`` asks for it."""
    wanted = [
        "record_id", "date", "time", "ring_number", "species_code", "swedish_name", "age",
        "weight", "wing_length", "fat_score", "muscle_score",
    ]
    chosen = select_captures(captures, start_date, end_date, species_codes).where(
        F.col("date").isNotNull() & F.col("time").isNotNull())
    stamped = chosen.select(
        *wanted, at_minute(F.col("date"), F.col("time")).alias("capture_ts"))
    fresh = null_if_stale(_matched(stamped, weather, 2, bucket_seconds), max_gap_hours)
    result = fresh.select(*wanted, "weather_ts", "weather_match_hours", *MATCHED)
    return result.orderBy("date", "time", "species_code", "record_id") if ordered else result


def to_long(weather: DataFrame, measures: Sequence[str] = tuple(WEATHER_MEASURES)) -> DataFrame:
    """One row per timestamp and measure that has a value."""
    return weather.unpivot(
        "observation_time", list(measures), "parameter", "value"
    ).where(F.col("value").isNotNull())

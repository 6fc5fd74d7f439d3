"""Captures against weather: daily and weekly tables, trends, bins, correlations.

Daily tables have one row per calendar day. That bound is what allows the few windows and
whole-table rankings below that would not be allowed over captures.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import bins
from skerry.functions.dates import ringing_season
from skerry.operators.distribution import box_stats
from skerry.operators.filters import positive, valid_fat
from skerry.operators.joins import keep_top, keep_top_groups

TREND_VARIABLES = (
    "mean_temperature", "mean_wind_speed", "total_precipitation", "mean_visibility",
    "mean_humidity", "mean_cloud_cover", "mean_pressure",
)
DAILY_WEATHER = (
    "mean_temperature", "min_temperature", "max_temperature", "mean_wind_speed",
    "mean_visibility", "max_gust", "mean_humidity", "total_precipitation", "mean_pressure",
    "mean_cloud_cover",
)
CORRELATED = (
    "captures", "mean_temperature", "mean_wind_speed", "max_gust", "mean_visibility",
    "mean_humidity", "total_precipitation", "mean_pressure", "mean_cloud_cover",
)


def daily_all(ringing: DataFrame) -> DataFrame:
    """All species of a day together, from ``weather.ringing_with_daily_weather``. The weather is
    the same in all rows of a day, so any aggregate picks it."""
    daily = ringing.groupBy("date").agg(
        F.sum("captures").alias("captures"), *[F.max(c).alias(c) for c in DAILY_WEATHER])
    return daily.withColumns({
        "month": F.month("date"), "season": ringing_season(F.month("date")),
        "year": F.year("date"),
    })


def weekly_all(daily: DataFrame) -> DataFrame:
    """Weeks from Monday. A week without any rain value counts as no rain; the season is that of
    the first day with captures."""
    mean = ("mean_temperature", "mean_wind_speed", "mean_visibility", "mean_humidity",
            "mean_pressure", "mean_cloud_cover")
    weekly = daily.groupBy(F.trunc("date", "WEEK").alias("week_start")).agg(
        F.sum("captures").alias("captures"),
        *[F.avg(c).alias(c) for c in mean],
        F.max("max_gust").alias("max_gust"),
        F.coalesce(F.sum("total_precipitation"), F.lit(0.0)).alias("total_precipitation"),
        F.min_by("month", "date").alias("month"),
    )
    return weekly.withColumn("season", ringing_season(F.col("month")))


def ols_trend(
    df: DataFrame, y: str = "captures", variables: Sequence[str] = TREND_VARIABLES,
    min_points: int = 5, by: Sequence[str] = (),
) -> DataFrame:
    """Least-squares line of ``y`` on each variable, where more than ``min_points`` rows have
    both. One aggregate computes all lines."""
    fits = [
        F.struct(
            F.lit(x).alias("variable"), F.regr_count(y, x).alias("n"),
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        ).alias(f"_{x}")
        for x in variables
    ]
    lines = F.inline(F.array(*[F.col(f"_{x}") for x in variables]))
    fitted = df.groupBy(*by).agg(*fits).select(*by, lines)
    return fitted.where(F.col("n") > min_points)


def weather_bins(daily: DataFrame) -> DataFrame:
    """Days with captures and their wind, temperature, cloud and rain category."""
    rain = F.coalesce("total_precipitation", F.lit(0.0))
    return daily.where(F.col("captures") > 0).withColumns({
        "wind_cat": bins.cut(F.col("mean_wind_speed"), *bins.WIND),
        "temp_cat": bins.cut(F.col("mean_temperature"), *bins.TEMPERATURE),
        "cloud_cat": bins.cut(F.col("mean_cloud_cover"), *bins.CLOUD),
        "precip_cat": bins.cut(rain, *bins.RAIN),
    })


def captures_by_bin(binned: DataFrame) -> DataFrame:
    """Box statistics of daily captures per category of :func:`weather_bins`."""
    kinds = ["wind_cat", "temp_cat", "cloud_cat", "precip_cat"]
    long = binned.unpivot("captures", kinds, "category", "bin").where(F.col("bin").isNotNull())
    return box_stats(long, "captures", ["category", "bin"], bounded=True)


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] = CORRELATED
) -> DataFrame:
    """Pearson correlation of every pair over the rows that have both values, as long rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    measured = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(
                F.lit(left).alias("var_a"), F.lit(right).alias("var_b"),
                F.col(f"`{a}|{b}`").alias("r")))
    return measured.select(F.inline(F.array(*cells)))


def matched_captures(at_capture: DataFrame, top_n: int = 6, max_gap_hours: float = 2):
    """Captures with trustworthy weather of the most frequent species."""
    fresh = at_capture.where(F.col("weather_match_hours") <= max_gap_hours)
    return keep_top(fresh, "swedish_name", top_n)


def capture_weather_points(matched: DataFrame) -> DataFrame:
    """One row per capture, weather variable and body metric with both values usable."""
    usable = {
        "fat_score": F.when(valid_fat(), F.col("fat_score").cast("double")),
        "weight": F.when(positive("weight"), F.col("weight")),
    }
    points = F.array(*[
        F.struct(F.lit(x).alias("variable"), F.col(x).alias("x"),
                 F.lit(metric).alias("metric"), y.alias("y"))
        for x in ("temperature", "wind_speed") for metric, y in usable.items()
    ])
    return matched.select("record_id", "swedish_name", "date", F.inline(points)).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    ).withColumn("season", ringing_season(F.month("date")))


def points_trend(points: DataFrame, min_points: int = 10) -> DataFrame:
    """Least-squares line per variable and metric of :func:`capture_weather_points`."""
    return points.groupBy("variable", "metric").agg(
        F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
    ).where(F.col("n") > min_points)


def diversity_weather(diversity: DataFrame, summary: DataFrame) -> DataFrame:
    """``captures.daily_diversity`` beside ``weather.daily_weather_summary`` where both have the
    day, with the season."""
    return diversity.join(summary, "date").withColumn("season", ringing_season(F.month("date")))


def weight_by_wind(
    at_capture: DataFrame, top_n: int = 4, among: int = 6, max_gap_hours: float = 2
) -> DataFrame:
    """Box statistics of weight per species and wind category, for the species with most such
    captures ``among`` the most frequent ones.

    Captures are counted per species, category and weight first; both rankings and the statistics
    work on these counts, so that the weather is not matched again for each of them."""
    counts = at_capture.where(F.col("weather_match_hours") <= max_gap_hours).groupBy(
        "swedish_name", bins.cut(F.col("wind_speed"), *bins.WIND).alias("wind_cat"), "weight"
    ).agg(F.count(F.lit(1)).alias("_n"))
    frequent = keep_top_groups(counts, "swedish_name", among, "_n")
    weighed = frequent.where(positive("weight") & F.col("wind_cat").isNotNull())
    return box_stats(keep_top_groups(weighed, "swedish_name", top_n, "_n"), "weight",
                     ["swedish_name", "wind_cat"], weight="_n")


def days_with_captures(daily: DataFrame) -> DataFrame:
    """Days with captures, a temperature and a wind speed."""
    return daily.where(
        (F.col("captures") > 0) & F.col("mean_temperature").isNotNull()
        & F.col("mean_wind_speed").isNotNull())


def capture_grid(
    daily: DataFrame, cells: Mapping[str, int] | None = None
) -> DataFrame:
    """Captures summed over an equal-width grid, 25 temperatures by 20 wind speeds."""
    cells = dict(cells or {"mean_temperature": 25, "mean_wind_speed": 20})
    everything = Window.partitionBy()  # one row per calendar day

    def cell(name: str) -> Column:
        low, high = F.min(name).over(everything), F.max(name).over(everything)
        return bins.grid_cell(F.col(name), low, high, cells[name]).alias(f"{name}_cell")

    placed = days_with_captures(daily).select("captures", *[cell(name) for name in cells])
    return placed.groupBy(*[f"{name}_cell" for name in cells]).agg(
        F.sum("captures").alias("captures"), F.count(F.lit(1)).alias("n_days"))

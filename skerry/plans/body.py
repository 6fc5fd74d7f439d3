"""Weights, wings, fat and age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.dates import DateLike
from skerry.operators.distribution import box_stats, distribution
from skerry.operators.filters import filled, of_years, positive, select_captures, valid_fat
from skerry.operators.joins import share_of_total
from skerry.plans.captures import rows
from skerry.plans.phenology import SPECIES
from skerry.schemas import column


def morphometric_distributions(
    df: DataFrame, species_codes: Sequence[str] | None = None, year: int | None = None
) -> DataFrame:
    """Captures with both weight and wing, one row each."""
    chosen = select_captures(df, species_codes=species_codes, start_year=year, end_year=year)
    measured = chosen.where(F.col("weight").isNotNull() & F.col("wing_length").isNotNull())
    return measured.select(
        *SPECIES, "weight", "wing_length", "age",
        F.year("date").alias("year"), F.month("date").alias("month"),
    )


def body_metrics(
    df: DataFrame, metric: str = "weight", group_by: Sequence[str] = ("species_code", "age")
) -> DataFrame:
    """Size, mean, spread, range and discrete quartiles of a metric per group."""
    kind = df.schema[metric].dataType
    stats = distribution(df, metric, group_by)
    observed = ["min", "q25", "median", "q75", "max"]
    return stats.select(
        *[column(k) for k in group_by], "n",
        F.col("mean").alias(f"mean_{metric}"), F.col("std").alias(f"std_{metric}"),
        *[F.col(name).cast(kind).alias(f"{name}_{metric}") for name in observed],
    ).orderBy(*group_by)


def _weight_by(df: DataFrame, unit: str, part) -> DataFrame:
    weighed = df.where(positive("weight"))
    return weighed.groupBy(*SPECIES, part.alias(unit)).agg(
        F.avg("weight").alias("mean_weight"), F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"), rows().alias("n"),
    ).orderBy("species_code", unit)


def weekly_weight(
    df: DataFrame, species_codes: Sequence[str] | None = None, year: int | None = None,
    start_date: DateLike | None = None, end_date: DateLike | None = None,
) -> DataFrame:
    """Weight per species and ISO week, of one year or of all years in the date bounds: the
    bounds only count where no year is given."""
    if year is not None:
        chosen = of_years(select_captures(df, species_codes=species_codes), year, year)
    else:
        chosen = select_captures(df, start_date, end_date, species_codes)
    return _weight_by(chosen, "week_of_year", F.weekofyear("date"))


def weekly_weight_for(
    df: DataFrame, species_codes: Sequence[str], start_date: DateLike, end_date: DateLike,
    selected_year: str | int = "all",
) -> DataFrame:
    """:func:`weekly_weight` as a year selector sets it, ``all`` being one of the choices."""
    year = None if selected_year == "all" else int(selected_year)
    return weekly_weight(df, species_codes, year, start_date, end_date)


def yearly_weight(
    df: DataFrame, species_codes: Sequence[str] | None = None,
    start_date: DateLike | None = None, end_date: DateLike | None = None,
) -> DataFrame:
    chosen = select_captures(df, start_date, end_date, species_codes)
    return _weight_by(chosen, "year", F.year("date"))


def measure_box(
    df: DataFrame, measure: str = "weight", species_codes: Sequence[str] | None = None,
    start_date: DateLike | None = None, end_date: DateLike | None = None,
) -> DataFrame:
    """Box statistics of the usable values of ``weight`` or ``wing_length`` per species."""
    chosen = select_captures(df, start_date, end_date, species_codes)
    return box_stats(chosen.where(positive(measure)), measure, ["swedish_name"])


def age_distribution(
    df: DataFrame, species_codes: Sequence[str] | None = None,
    start_date: DateLike | None = None, end_date: DateLike | None = None,
) -> DataFrame:
    chosen = select_captures(df, start_date, end_date, species_codes).where(filled("age"))
    counts = chosen.groupBy("swedish_name", "age").agg(rows().alias("count"))
    return share_of_total(counts, "count", ["swedish_name"], "total", "percentage")


def age_code_counts(
    df: DataFrame, species_names: Sequence[str] | None = None
) -> DataFrame:
    chosen = df if species_names is None else df.where(
        F.col("swedish_name").isin(*species_names))
    return chosen.groupBy("swedish_name", "age_code").agg(rows().alias("count"))


def fat_score(
    df: DataFrame, species_codes: Sequence[str] | None = None,
    start_date: DateLike | None = None, end_date: DateLike | None = None,
) -> DataFrame:
    chosen = select_captures(df, start_date, end_date, species_codes).where(valid_fat())
    return chosen.groupBy("swedish_name").agg(
        F.avg("fat_score").alias("mean_fat_score"),
        F.stddev_samp("fat_score").alias("std_fat_score"),
        rows().alias("count"),
    )

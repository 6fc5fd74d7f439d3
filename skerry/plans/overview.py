"""Summaries of a whole table or of a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.dates import DateLike
from skerry.operators.filters import select_captures
from skerry.plans.captures import rows
from skerry.schemas import column


def n_unique(name: str) -> Column:
    """Distinct values, null counting as one of them."""
    has_null = F.coalesce(F.max(column(name).isNull().cast("int")), F.lit(0))
    return F.count_distinct(column(name)) + has_null


def species_summary(df: DataFrame) -> DataFrame:
    """Per species: captures, individuals, dates, mean measurements and the commonest age (the
    smallest of equally common ones)."""
    keys = ["species_code", "swedish_name", "scientific_name"]
    # Ages are counted apart: one aggregate holding a map of ages for every ring would not fit a
    # hash aggregate.
    species = F.struct(*keys).alias("_species")
    ages = df.where(F.col("age").isNotNull()).groupBy(species, "age").agg(rows().alias("_n"))
    commonest = ages.groupBy("_species").agg(
        F.min(F.struct((-F.col("_n")).alias("_rank"), "age"))["age"].alias("most_common_age"))
    summary = df.groupBy(*keys).agg(
        rows().alias("total_records"),
        n_unique("ring_number").alias("unique_individuals"),
        F.min("date").alias("first_sighting"),
        F.max("date").alias("last_sighting"),
        F.avg("weight").alias("mean_weight"),
        F.stddev_samp("weight").alias("std_weight"),
        F.avg("wing_length").alias("mean_wing_length"),
        F.stddev_samp("wing_length").alias("std_wing_length"),
        F.avg("fat_score").alias("mean_fat_score"),
    ).withColumn("_species", species)
    return summary.join(commonest, "_species", "left").drop("_species").orderBy(F.desc("total_records"), *keys)


def summary_stats(df: DataFrame) -> DataFrame:
    """One row about the table; the most frequent species come from ``captures.top_species``."""
    return df.agg(
        rows().alias("total_records"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("species_code").alias("unique_species"),
        F.count_distinct("ringer").alias("unique_ringers"),
    )


def selection_summary(
    df: DataFrame, start_date: DateLike, end_date: DateLike,
    species_codes: Sequence[str] | None = None,
) -> DataFrame:
    """One row about a selection; no species means all of them."""
    return select_captures(df, start_date, end_date, species_codes).agg(
        rows().alias("total_records"),
        n_unique("species_code").alias("unique_species"),
        n_unique("ring_number").alias("unique_individuals"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def species_options(df: DataFrame) -> DataFrame:
    return df.select("species_code", "swedish_name").distinct().orderBy(
        "species_code", "swedish_name")


def year_options(df: DataFrame) -> DataFrame:
    return df.select(F.year("date").alias("year")).distinct().orderBy("year")


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: non-null values, smallest and largest as text. One aggregate over the
    table, then its single row is unfolded."""
    names = list(columns or df.columns)
    measured = df.agg(*[
        F.struct(
            F.lit(name).alias("column"), F.count(column(name)).alias("non_null"),
            F.min(column(name)).cast("string").alias("smallest"),
            F.max(column(name)).cast("string").alias("largest"),
        ).alias(f"_{i}")
        for i, name in enumerate(names)
    ])
    return measured.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(names))])))

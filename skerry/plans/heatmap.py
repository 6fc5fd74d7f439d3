"""Species by week heat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.filters import of_years
from skerry.plans.captures import rows
from skerry.plans.phenology import SPECIES


def _top(weekly: DataFrame, n: int) -> DataFrame:
    """Codes of the species with the most captures, from counts per species and week."""
    return weekly.groupBy(*SPECIES).agg(F.sum("count").alias("_all")).orderBy(
        F.desc("_all"), *SPECIES).limit(n).select("species_code").distinct()


def weekly_heatmap(df: DataFrame, year: int | None = None, top_n_species: int = 30) -> DataFrame:
    """Weekly counts of the most captured species and each week's share of the species' total, in
    one year or averaged over the years a week has data in.

    Captures are counted once per species, week and year; the ranking, the totals and the shares
    all derive from those counts."""
    chosen = df if year is None else of_years(df, year, year)
    yearly = chosen.groupBy(
        *SPECIES, F.weekofyear("date").alias("week_of_year"), F.year("date").alias("_year")
    ).agg(rows().alias("_rows"))
    weekly = yearly.groupBy(*SPECIES, "week_of_year").agg(
        F.sum("_rows").alias("count"), F.count("_year").alias("_years"))
    # An inner join on distinct codes: unlike a semi join, Spark leaves it above the aggregate, so
    # ranking and report share one scan and one shuffle.
    kept = weekly.join(_top(weekly, top_n_species), "species_code")
    species = Window.partitionBy("species_code")
    total = F.sum("count").over(species)
    if year is not None:
        result = kept.select(
            *SPECIES, "week_of_year", "count", total.alias("total_count"),
            F.round(F.lit(100.0) * F.col("count") / total, 2).alias("percent_of_total"))
    else:
        per_year = F.col("count") / F.nullif(F.col("_years"), F.lit(0))
        usual = total / F.nullif(F.avg("_years").over(species), F.lit(0.0))
        result = kept.select(
            *SPECIES, "week_of_year", F.round(per_year, 1).alias("avg_count"),
            total.alias("total_count"),
            F.round(F.lit(100.0) * per_year / usual, 2).alias("percent_of_total"))
    return result.orderBy(F.desc("total_count"), "species_code", "week_of_year")


def heatmap_matrix(heatmap: DataFrame, last_week: int | None = None) -> DataFrame:
    """Share per species (row, largest sum first) and week (column), absent weeks as zero.

    Weeks 1 to 52 are always there; week 53 is added if it has data, which takes a look at the
    heat map unless ``last_week`` says so."""
    if last_week is None:
        last_week = 52 if heatmap.where(F.col("week_of_year") == 53).isEmpty() else 53
    weeks = list(range(1, last_week + 1))
    wide = heatmap.groupBy("swedish_name").pivot("week_of_year", weeks).agg(
        F.avg("percent_of_total")).fillna(0.0)
    row_sum = sum((F.col(f"`{week}`") for week in weeks), F.lit(0.0))
    return wide.orderBy(row_sum.desc(), "swedish_name")

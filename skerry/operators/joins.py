"""Equality joins on keys: lookups, gap filling, wide tables from long ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.schemas import column

GAP_FILLED = ("precipitation", "pressure", "visibility")


def merge_metadata(
    df: DataFrame, metadata: DataFrame, on: str = "species_code", how: str = "left"
) -> DataFrame:
    """Join a dimension on its key: ``left``, ``inner`` or ``outer``. Spark broadcasts the
    dimension when its size allows."""
    if how not in ("left", "inner", "outer"):
        raise ValueError("how is left, inner or outer")
    return df.join(metadata, on, how)


def one_per_key(df: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """The greatest row per key by ``order``, then by content. An aggregate, not a window: a key
    with very many rows is reduced before the shuffle."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct("*").alias("row"))
    best = df.groupBy(column(key).alias("_key")).agg(F.max(ranked).alias("_best"))
    return best.select("_best.row.*")


def species_lookup(df: DataFrame, metadata: DataFrame, on: str = "species_code") -> DataFrame:
    """Attach names and taxon id from a name-search export whose search term, in upper case, is
    the species code. Unknown codes get nulls; a term listed twice does not multiply rows."""
    # The column names of the export.
    names = metadata.select(
        F.upper(column("Sökträff")).alias("_term"),
        column("Vetenskapligt namn").alias("scientific_name"),
        column("Svenskt namn").alias("swedish_name"),
        column("TaxonID").alias("TaxonID"),
    ).where(F.col("_term").isNotNull())
    lookup = one_per_key(names, "_term")
    return df.join(lookup, column(on) == F.col("_term"), "left").drop("_term")


def top_by_count(df: DataFrame, keys: Sequence[str], n: int, count: str = "count") -> DataFrame:
    """The ``n`` most frequent key combinations; ties go to the smaller key."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), *[F.asc_nulls_last(k) for k in keys]).limit(n)
    )


def keep_top(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose ``key`` is among its ``n`` most frequent non-null values."""
    top = top_by_count(df.where(column(key).isNotNull()), [key], n).select(key)
    return df.join(top, key, "left_semi")


def keep_top_groups(counts: DataFrame, key: str, n: int, count: str = "count") -> DataFrame:
    """From counts per ``key`` and something else: the rows of the ``n`` keys with most in all.
    Ranking the counts instead of the rows they came from saves a scan."""
    top = counts.where(column(key).isNotNull()).groupBy(key).agg(
        F.sum(count).alias("_all")).orderBy(F.desc("_all"), key).limit(n).select(key)
    return counts.join(top, key)


def skew_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` in a way that lets adaptive execution split a hot key of ``left``.

    It only splits where both sides come straight from a shuffle made for the join. A right side
    aggregated or windowed by the same keys is already placed by them and would be joined as it
    is. The extra key, a hash of the others, asks for that shuffle of the (small) right side."""
    slot = F.xxhash64(*[column(k) for k in keys])
    return left.withColumn("_slot", slot).join(
        right.withColumn("_slot", slot), ["_slot", *keys], how).drop("_slot")


def join_per_source(
    df: DataFrame, facts: DataFrame, source: str, how: str = "inner"
) -> DataFrame:
    """Attach facts about each source (a file, say) to its rows. Spark broadcasts the facts when
    their size allows; otherwise adaptive execution splits a source that holds very many rows."""
    return skew_safe_join(df, facts, [source], how)


def share_of_total(
    df: DataFrame, count: str, within: Sequence[str], total: str, percent: str
) -> DataFrame:
    """Add the group total and the percentage of it. ``df`` is already aggregated, so a window
    replaces joining it to its own totals."""
    whole = F.sum(count).over(Window.partitionBy(*within))
    return df.withColumn(total, whole).withColumn(
        percent, F.lit(100.0) * F.col(count) / F.col(total)
    )


def with_backup(
    primary: DataFrame, backup: DataFrame, columns: Sequence[str] = GAP_FILLED,
    on: str = "observation_time",
) -> DataFrame:
    """Left join a backup series on its timestamp and add ``backup_<column>``."""
    spare = backup.select(column(on), *[column(c).alias(f"backup_{c}") for c in columns])
    return primary.join(spare, on, "left")


def filled_from_backup(name: str) -> Column:
    return F.coalesce(column(name), column(f"backup_{name}"))


def fillable(name: str) -> Column:
    """The primary value is missing and the backup has one."""
    return column(name).isNull() & column(f"backup_{name}").isNotNull()


def patch_from_backup(
    primary: DataFrame, backup: DataFrame, columns: Sequence[str] = GAP_FILLED,
    on: str = "observation_time",
) -> DataFrame:
    """The primary table with missing values, and their quality flags, taken from the backup."""
    flags = [f"{c}_quality" for c in columns if f"{c}_quality" in primary.columns]
    joined = with_backup(primary, backup, [*columns, *flags], on)
    patched = {}
    for name in columns:
        quality = f"{name}_quality"
        if quality in flags:
            patched[quality] = F.when(fillable(name), column(f"backup_{quality}")).otherwise(
                column(quality))
        patched[name] = filled_from_backup(name)
    return joined.withColumns(patched).select(*[column(c) for c in primary.columns])


def fillable_counts(
    primary: DataFrame, backup: DataFrame, columns: Sequence[str] = GAP_FILLED,
    on: str = "observation_time",
) -> DataFrame:
    """One row: how many values of each column the backup could supply."""
    joined = with_backup(primary, backup, columns, on)
    return joined.agg(*[F.count_if(fillable(c)).alias(f"{c}_fillable") for c in columns])


def null_audit(
    df: DataFrame, columns: Sequence[str] = GAP_FILLED, on: str = "observation_time"
) -> DataFrame:
    """One row: remaining nulls per column and the date range."""
    return df.agg(
        *[F.count_if(column(c).isNull()).alias(f"{c}_null") for c in columns],
        F.min(column(on).cast("date")).alias("min_date"),
        F.max(column(on).cast("date")).alias("max_date"),
    )


def latest_by_time(
    *sources: DataFrame, on: str = "observation_time", priority: str = "_priority"
) -> DataFrame:
    """Stack sources and keep, per timestamp, the row of the last source that has one.

    Missing columns become null. A running number per source decides, inside an aggregate."""
    stacked = None
    for index, source in enumerate(sources):
        tagged = source.withColumn(priority, F.lit(index))
        stacked = tagged if stacked is None else stacked.unionByName(
            tagged, allowMissingColumns=True)
    return one_per_key(stacked, on, [column(priority)]).drop(priority)


def widen(
    long: DataFrame, parameters: Sequence[str], on: str = "observation_time",
    parameter: str = "parameter", value: str = "value", quality: str | None = None,
) -> DataFrame:
    """One row per timestamp with a column per parameter: one shuffle instead of a chain of full
    outer joins. ``long`` has at most one row per timestamp and parameter."""
    columns = []
    for name in parameters:
        here = column(parameter) == name
        columns.append(F.max(F.when(here, column(value))).alias(name))
        if quality:
            columns.append(F.max(F.when(here, column(quality))).alias(f"{name}_quality"))
    return long.where(column(parameter).isin(*parameters)).groupBy(on).agg(*columns)

"""Whole-table cleaning: strings, sparse columns, duplicates, collation of many files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.cleaning import iso_date, number, trimmed
from skerry.operators.joins import join_per_source, species_lookup
from skerry.schemas import column

MEASURES = (
    "wing_length", "weight", "fat_score", "muscle_score", "brood_patch", "moult_score",
)


def clean_strings(df: DataFrame, date_column: str = "date") -> DataFrame:
    """Trim every string, turn empty ones into null, and parse the date column if it is text."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    cleaned = {name: trimmed(column(name)) for name in text}
    if date_column in text:
        cleaned[date_column] = iso_date(cleaned[date_column])
    return df.withColumns(cleaned) if cleaned else df


def sparseness(
    df: DataFrame, columns: Sequence[str], source: str | None = None, threshold: float = 0.7
) -> DataFrame:
    """Per source, or once: ``_keep_<column>``, whether fewer than ``threshold`` of the rows are
    null in it. An aggregate, never a window: one source may hold most rows."""
    return df.groupBy(*([source] if source else [])).agg(*[
        (F.count_if(column(c).isNull()) < F.count(F.lit(1)) * F.lit(threshold)).alias(f"_keep_{c}")
        for c in columns
    ])


def blank_sparse_columns(
    df: DataFrame, columns: Sequence[str], source: str | None = None, threshold: float = 0.7,
) -> DataFrame:
    """Null out a column wherever at least ``threshold`` of its rows are null, judged per
    ``source`` (say, the file a row came from) or over all rows."""
    ratios = sparseness(df, columns, source, threshold)
    if source:
        flagged = join_per_source(df, ratios, source)
        keep = {c: F.col(f"_keep_{c}") for c in columns}
    else:
        flagged = df
        verdict = ratios.select(F.struct(*ratios.columns).alias("_keep")).scalar()
        keep = {c: verdict[f"_keep_{c}"] for c in columns}
    return flagged.withColumns({c: F.when(keep[c], column(c)) for c in columns}).select(
        *[column(c) for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value. The schema depends on the data, so this runs one
    aggregate that returns a single row."""
    seen = df.agg(*[F.count(column(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if not seen[c]])


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("all", subset=list(columns) if columns else None)


def deduplicate(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed; copies collapse before the shuffle."""
    return df.dropDuplicates()


def collate_reports(
    raw: DataFrame, scheme: str, station: str, metadata: DataFrame | None = None,
    source: str = "source_file",
) -> DataFrame:
    """Raw report rows of many files (see ``sources.reports``) to one clean table.

    Sparse columns are blanked per file, text becomes dates and numbers, rows of other schemes or
    stations go, duplicates within and across files go, and species names are looked up. Rows are
    selected before anything is joined or parsed; only the sparseness is judged on all rows. A
    row without any value has no scheme, so the selection drops it too."""
    data = [c for c in raw.columns if c not in (source, "scheme", "station_code", "station_name")]
    wanted = raw.where((column("scheme") == scheme) & (column("station_name") == station))
    kept = join_per_source(
        wanted, sparseness(raw, data, source), source
    ).select(*[F.when(F.col(f"_keep_{c}"), column(c)).alias(c) for c in data])
    parsers = {"date": iso_date, **{name: number for name in ("time", *MEASURES)}}
    order = ["date", "time"] + [c for c in data if c not in ("date", "time")]
    typed = kept.select(*[
        parsers.get(c, lambda value: value)(column(c)).alias(c) for c in order])
    # Hardly any row repeats, so collapsing copies task by task would hold all rows of a split. Rows are
    # dealt out by content first, in parts of bounded size; adaptive execution splits one of many copies.
    dealt = typed.withColumn("_slot", F.xxhash64(*[column(c) for c in order])).hint("rebalance", "_slot")
    unique = deduplicate(dealt.select(*[column(c) for c in order]))
    return species_lookup(unique, metadata) if metadata is not None else unique

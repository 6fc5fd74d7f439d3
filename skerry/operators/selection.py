"""Selecting public observations by place, taxon, provider and time, and cutting a period into
windows of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.dates import DateLike, as_date
from skerry.schemas import column
from skerry.session import checkpointed

# Centre of the station (WGS84), radius, default provider, rows per export window.
STATION_LONGITUDE, STATION_LATITUDE = 11.90056, 57.30250
RADIUS_M = 5000
PROVIDER_ID = 1
WINDOW_LIMIT = 25_000
WINDOW_FIRST_YEAR = 1950

EARTH_RADIUS_M = 6_371_008.8


def distance_m(latitude: Column, longitude: Column, lat: float, lon: float) -> Column:
    """Great-circle distance to a fixed point (haversine)."""
    half_lat = F.radians(latitude - lat) / 2
    half_lon = F.radians(longitude - lon) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(latitude)) * math.cos(
        math.radians(lat)
    ) * F.pow(F.sin(half_lon), F.lit(2))
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_M)


def within_radius(
    df: DataFrame, lat: float = STATION_LATITUDE, lon: float = STATION_LONGITUDE,
    radius_m: float = RADIUS_M, latitude: str = "DecimalLatitude",
    longitude: str = "DecimalLongitude",
) -> DataFrame:
    """Rows within ``radius_m``. A bounding box comes first: plain comparisons that the Parquet
    reader can use to skip row groups."""
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * 1.0001
    box = column(latitude).between(lat - reach, lat + reach)
    shrink = math.cos(math.radians(min(abs(lat) + reach, 90.0)))
    if shrink > 0 and reach / shrink < 180 and abs(lon) + reach / shrink < 180:
        box = box & column(longitude).between(lon - reach / shrink, lon + reach / shrink)
    exact = distance_m(column(latitude), column(longitude), lat, lon) <= radius_m
    return df.where(box).where(exact)


def of_taxa(df: DataFrame, taxa: DataFrame, on: str = "DyntaxaTaxonId") -> DataFrame:
    """Rows whose taxon is in ``taxa``, a one-column table as from :func:`descendants`."""
    return df.join(taxa.toDF(on), on, "left_semi")


def descendants(
    taxonomy: DataFrame, root: int, taxon: str = "taxon_id", parent: str = "parent_id",
) -> DataFrame:
    """The root taxon and everything below it, from a child-to-parent table.

    Every pass lifts each taxon to its parent's parent, so n passes cover 2 ** n levels; they end
    when one finds nothing new, at any depth and also where parents form a circle."""
    up = taxonomy.select(column(taxon).alias("_taxon"), column(parent).alias("_up"),
                         (column(parent) == root).alias("_hit"))
    known = -1
    while (hits := up.where("_hit").count()) > known:
        known = hits
        above = up.select(F.col("_taxon").alias("_via"), F.col("_up").alias("_next"),
                          F.col("_hit").alias("_above"))
        up = up.join(above, F.col("_up") == F.col("_via"), "left").select(
            "_taxon", F.col("_next").alias("_up"),
            (F.coalesce(F.col("_hit"), F.lit(False))
             | F.coalesce(F.col("_above"), F.lit(False))).alias("_hit"),
        )
        up = checkpointed(up)
    found = up.where(F.col("_hit") | (F.col("_taxon") == root)).select("_taxon")
    return found.distinct().toDF(taxon)


def select_observations(
    df: DataFrame,
    start_date: DateLike,
    end_date: DateLike,
    lat: float = STATION_LATITUDE,
    lon: float = STATION_LONGITUDE,
    radius_m: float = RADIUS_M,
    provider_id: int | None = PROVIDER_ID,
    taxa: DataFrame | None = None,
) -> DataFrame:
    """Observations that start and end within the dates, lie within the radius, come from the
    provider and belong to the taxa."""
    begins, ends = column("StartDate").cast("date"), column("EndDate").cast("date")
    selected = df.where((begins >= as_date(start_date)) & (ends <= as_date(end_date)))
    if provider_id is not None:
        selected = selected.where(column("DataProviderId") == provider_id)
    selected = within_radius(selected, lat, lon, radius_m)
    return of_taxa(selected, taxa) if taxa is not None else selected


def count_per_period(df: DataFrame, period: Column, on: str = "StartDate") -> DataFrame:
    return df.where(column(on).isNotNull()).groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("n"))


def adaptive_windows(
    df: DataFrame, on: str = "StartDate", limit: int = WINDOW_LIMIT, chunk_years: int = 10,
    first_year: int = WINDOW_FIRST_YEAR, last_year: int | None = None,
) -> DataFrame:
    """One row per day that has data, labelled with the window it belongs to.

    A window is the widest of chunk of years, year, month and day holding at most ``limit`` rows;
    a day is never split. Counting per day comes first, so the windows over chunks only ever see
    calendar days. Chunks are counted from ``first_year``, before it as well as after, and cut at
    the end of ``last_year``. Rows without a date share the window ``undated``, which has no day."""
    day, year = column(on).cast("date"), F.year("day")
    daily = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("day_rows"))
    chunk = year - F.pmod(year - first_year, F.lit(chunk_years))
    chunk_end = chunk + chunk_years - 1
    if last_year is not None:
        later = year > last_year
        chunk_end = F.when(later, chunk_end).otherwise(F.least(chunk_end, F.lit(last_year)))
        chunk = F.when(later, F.greatest(chunk, F.lit(last_year + 1))).otherwise(chunk)
    dated = daily.withColumns({
        "_chunk": chunk, "_chunk_end": chunk_end, "_year": year, "_month": F.trunc("day", "MONTH"),
    })
    totals = dated.withColumns({
        "_in_chunk": F.sum("day_rows").over(Window.partitionBy("_chunk")),
        "_in_year": F.sum("day_rows").over(Window.partitionBy("_chunk", "_year")),
        "_in_month": F.sum("day_rows").over(Window.partitionBy("_chunk", "_year", "_month")),
    })
    fits = [
        (F.col("_in_chunk") <= limit, "chunk", F.make_date("_chunk", F.lit(1), F.lit(1)),
         F.make_date("_chunk_end", F.lit(12), F.lit(31)), "_in_chunk"),
        (F.col("_in_year") <= limit, "year", F.make_date("_year", F.lit(1), F.lit(1)),
         F.make_date("_year", F.lit(12), F.lit(31)), "_in_year"),
        (F.col("_in_month") <= limit, "month", F.col("_month"), F.last_day("_month"), "_in_month"),
    ]

    def widest(pick, day_value: Column, undated: Column) -> Column:
        choice = F.when(F.col("day").isNull(), undated)
        for fit in fits:
            choice = choice.when(fit[0], pick(fit))
        return choice.otherwise(day_value)

    return totals.select(
        "day", "day_rows",
        widest(lambda f: F.lit(f[1]), F.lit("day"), F.lit("undated")).alias("level"),
        widest(lambda f: f[2], F.col("day"), F.col("day")).alias("window_start"),
        widest(lambda f: f[3], F.col("day"), F.col("day")).alias("window_end"),
        widest(lambda f: F.col(f[4]), F.col("day_rows"), F.col("day_rows")).alias("window_rows"),
    )


def window_summary(windows: DataFrame) -> DataFrame:
    """One row per window."""
    return windows.groupBy("level", "window_start", "window_end").agg(
        F.max("window_rows").alias("n_rows"))


def label_windows(df: DataFrame, windows: DataFrame, on: str = "StartDate") -> DataFrame:
    """Attach ``window_id`` to every row, to write an export in parts of bounded size. Rows without
    a date get ``undated``, rows on a day that ``windows`` lacks a null.

    ``windows`` has one short row per calendar day, which bounds its size whatever the data
    volume, so it is broadcast and the rows stay where they are."""
    named = windows.select(
        "day", F.concat_ws(":", "level", F.col("window_start").cast("string")).alias("window_id"))
    labelled = df.withColumn("_day", column(on).cast("date")).join(
        F.broadcast(named), F.col("_day") == F.col("day"), "left")
    undated = F.when(F.col("_day").isNull(), "undated").otherwise(F.col("window_id"))
    return labelled.withColumn("window_id", undated).drop("_day", "day")

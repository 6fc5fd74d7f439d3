"""Weather station exports: a preamble, a header, then ``date;time;value;quality`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.cleaning import clock_time, number
from skerry.operators.joins import join_per_source
from skerry.sources.lines import placed_lines

# Parameter number in the station network and the column it fills.
PARAMETERS = {
    1: "temperature", 3: "wind_direction", 4: "wind_speed", 6: "humidity", 7: "precipitation",
    9: "pressure", 12: "visibility", 16: "cloud_cover", 21: "gust_wind",
}


def parse_station_lines(lines: DataFrame, measure: str) -> DataFrame:
    """Columns ``observation_time``, ``<measure>``, ``<measure>_quality``.

    A data line is one whose first two fields form a date and a time; that leaves out the
    preamble and the header without having to find them. A value that is no number is null."""
    def field(position: int):
        return F.get("_parts", F.lit(position))

    return lines.select(F.split("value", ";").alias("_parts")).select(
        clock_time(field(0), field(1)).alias("observation_time"),
        number(field(2)).alias(measure),
        F.nullif(F.trim(field(3)), F.lit("")).alias(f"{measure}_quality"),
    ).where(F.col("observation_time").isNotNull())


def below_header(lines: DataFrame) -> DataFrame:
    """The lines (source_file, place, value) that follow their file's first header line. Raises a
    ValueError that names files without one."""
    is_header = F.lower(F.trim("value")).startswith("datum")
    headers = lines.groupBy("source_file").agg(F.min(F.when(is_header, F.col("place"))).alias("_header"))
    headless = headers.where(F.col("_header").isNull()).select("source_file").limit(5).collect()
    if headless or headers.isEmpty():
        raise ValueError(f"no data header in {', '.join(r.source_file for r in headless) or 'empty files'}")
    return join_per_source(lines, headers, "source_file").where(F.col("place") > F.col("_header"))


def read_station_export(spark: SparkSession, path: str | list[str], measure: str) -> DataFrame:
    """Parse export files. One without a header is not an export, which is an error; one with
    a header and nothing else adds no rows. What comes before a header is left out.

    The place of a line is where its split of the file starts, then the order within the split."""
    lines = placed_lines(spark, path).select("source_file", F.struct("block", "line").alias("place"), "value")
    return parse_station_lines(below_header(lines), measure)

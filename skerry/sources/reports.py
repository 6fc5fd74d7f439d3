"""Ring reports: prefix-tagged text lines, of which the data lines are pipe-separated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.cleaning import REPORT_NULLS, nulled
from skerry.sources.lines import cut_quoted, read_lines, split_quoted, unfold, unquoted

# What the first character of a line means. Everything else, the personal data of
# ringers (H) included, is dropped.
ROUTES = {
    "Q": "meta_header", "M": "meta_station", "S": "meta_ringer_initials", "L": "meta_locations",
    "C": "ring_records", "R": "ring_records",
}

# Position of each field in a data line.
FIELDS = {
    0: "record_type", 1: "ring_number", 2: "scheme", 3: "station_code", 4: "station_name",
    5: "age_code", 7: "date", 8: "time", 9: "species_code", 10: "ringer", 12: "age",
    17: "wing_length", 18: "weight", 19: "fat_score", 20: "muscle_score", 30: "brood_patch",
    32: "moult_score", 34: "notes",
}


def route_lines(lines: DataFrame) -> DataFrame:
    """Add ``route`` to every line that has one; blank lines and unknown prefixes go."""
    prefix = F.substring("value", 1, 1)
    route = F
    for name in dict.fromkeys(ROUTES.values()):
        tags = [tag for tag, target in ROUTES.items() if target == name]
        route = route.when(prefix.isin(*tags), name)
    return lines.where(F.trim("value") != "").withColumn("route", route).where(
        F.col("route").isNotNull())


def split_reports(spark: SparkSession, path: str | list[str], out: str) -> None:
    """Write yearly reports to ``out`` as text, one folder per report, route and place of origin.

    Reports of one name in different folders stay apart: ``folder`` is the name of the folder with
    a digest of its whole path."""
    lines = read_lines(spark, path)
    # Plain string functions: patterns searched in a whole path cost more than the rest of a line.
    name = F.substring_index("source_file", "/", -1)
    stem = F.left(name, F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)
    report = F.when(stem == "", name).otherwise(stem)  # the name itself: no dot in it, or none but its first character
    parent = F.left("source_file", F.length("source_file") - F.length(name) - 1)
    folder = F.concat_ws("-", F.substring_index(parent, "/", -1), F.substring(F.md5(parent), 1, 12))
    routed = route_lines(lines).select(report.alias("report"), folder.alias("folder"), "route", "value")
    routed.write.mode("overwrite").partitionBy("report", "route", "folder").text(out)


def parse_data_lines(lines: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The used fields of each data line as text, all eighteen or those named; missing-value tokens
    become null. A field in quotes may hold pipes and doubled quotes."""
    kept = [c for c in lines.columns if c not in ("value", "route")]
    wanted = {name: i for i, name in FIELDS.items() if fields is None or name in fields}
    # A few fields are freed from their quotes one by one. For all of them the compiled code would be too
    # long for the JVM to make it fast (44 against 14 s on 6 million lines), so the array is freed at once.
    few = len(wanted) <= 6
    cut = cut_quoted if few else split_quoted
    parts = unfold(lines, [cut(F.col("value"), "|").alias("_parts")], kept)

    def field(position: int) -> Column:
        cell = F.get("_parts", F.lit(position))
        return nulled(unquoted(cell) if few else cell, REPORT_NULLS)

    # Not unfolded again: a field is cheap to take from the parts, and ones not asked for are not taken.
    return parts.select(*kept, *[field(i).alias(name) for name, i in wanted.items()])


def read_ring_records(
    spark: SparkSession, root: str, report: str | None = None, fields: Sequence[str] | None = None,
) -> DataFrame:
    """The data lines below the folder that :func:`split_reports` wrote, with their file; all
    reports or one, all fields or those named. Route and report are folders, so others are not
    listed or read."""
    lines = spark.read.text(root).where(F.col("route") == "ring_records")
    if report is not None:
        lines = lines.where(F.col("report") == report)
    lines = lines.select(F.input_file_name().alias("source_file"), "value")
    return parse_data_lines(lines.where(F.trim("value") != ""), fields)

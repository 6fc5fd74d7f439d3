"""Comma-separated captures, tab-separated observation exports, stored tables and plain SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.cleaning import (
    EXPORT_NULLS, flag, nulled, number, offset_to_utc, trimmed, whole_number,
)
from skerry.operators.filters import matching
from skerry.operators.joins import skew_safe_join
from skerry.schemas import OBSERVATIONS, RING_RECORDS, column
from skerry.sources.lines import (
    decoded, encoding_flags, open_quote, placed_lines, split_quoted, unfold, whole_records,
)


def read_captures_csv(
    spark: SparkSession, path: str | list[str], overrides: Mapping[str, str] | None = None,
    infer: bool = False, **options: str,
) -> DataFrame:
    """A comma-separated file with a header. Columns are matched by name and cast to the declared
    type; ones not declared stay text, unless ``infer`` asks Spark to guess them at the price of
    a second pass. ``notes`` is always text. ``overrides`` maps a column to a Spark type."""
    raw = spark.read.options(header=True, inferSchema=infer, **options).csv(path)
    if "TaxonID" in raw.columns:
        raw = raw.withColumnRenamed("TaxonID", "taxon_id")
    declared = {f.name: f.dataType.simpleString() for f in RING_RECORDS} | {"notes": "string"}
    wanted = declared | dict(overrides or {})
    return raw.select(*[
        column(c).try_cast(wanted[c]).alias(c) if c in wanted else column(c) for c in raw.columns
    ])


def read_observation_export(
    spark: SparkSession, path: str | list[str], schema: T.StructType = OBSERVATIONS,
    key: str = "OccurrenceId",
) -> DataFrame:
    """Tab-separated export files, in UTF-8, windows-1252 or latin-1, as the columns of ``schema``.

    The first line of a file that is not blank is its header; files may order their columns
    differently, and one without the key column is an error. Fields in quotes may hold tabs, line
    ends (any of them read as a line feed) and doubled quotes. Null tokens and values that do not
    fit become null, fields beyond the header are ignored, offset timestamps become UTC, rows
    without a key are left out.

    One scan gives a row for each block of a file: how the file reads, where its columns are, and
    whether the block begins within quotes. The second scan meets these rows once."""
    lines = placed_lines(spark, path)
    filled = F.when(F.trim("value") != "", F.struct("block", "line", "value"))
    odd = open_quote(F.col("value"))
    blocks = lines.groupBy("source_file", "block").agg(
        *[c.alias(name) for name, c in encoding_flags(F.col("value")).items()],
        F.min(filled).alias("_first"), F.bool_or(odd).alias("_any"), F.sum(odd.cast("int")).alias("_odd"))
    whole = Window.partitionBy("source_file")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2 == 1
    closed = F.when(F.sum("_odd").over(whole) % 2 == 1, F.raise_error(
        F.concat(F.lit("a quote is not closed in "), F.col("source_file"))).cast("boolean")).otherwise(True)
    facts = blocks.select(
        "source_file", "block", F.bool_and("_utf8").over(whole).alias("_utf8"),
        F.bool_or("_odd_bytes").over(whole).alias("_odd_bytes"), F.min("_first").over(whole).alias("_first"),
        inside.alias("_inside"), "_any", closed.alias("_closed"))
    names = split_quoted(decoded(F.col("_first.value")), "\t")
    known = F.when(F.array_contains(names, key), True).otherwise(F.raise_error(
        F.concat(F.lit("no header line in "), F.col("source_file"))).cast("boolean"))
    # One array of positions instead of a column for each field.
    places = F.array(*[F.array_position("_names", f.name).cast("int") for f in schema])
    facts = facts.where("_first IS NOT NULL").withColumn("_names", names).select(
        "source_file", "block", "_utf8", "_odd_bytes", F.struct("_first.block", "_first.line").alias("_header"),
        places.alias("_places"), F.when(F.col("_any") | F.col("_inside"), F.col("_inside")).alias("inside"),
        (F.col("_closed") & known).alias("_known"))
    body = skew_safe_join(lines, facts, ["source_file", "block"]).where(
        F.col("_known") & (F.struct("block", "line") != F.col("_header")))
    # Lines are sorted with their file, so from here on it is the number of its header line, not a long path.
    records = whole_records(body.select(
        F.col("_header.line").alias("source_file"), "block", "line", decoded(F.col("value")).alias("value"), "inside", "_places"))
    return parse_records(records, schema, key)


def parse_records(records: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """Records (``value``, and at which field each column of ``schema`` is: ``_places``) as typed columns."""
    cells = unfold(records, [split_quoted(F.col("value"), "\t").alias("_cells")], ["_places"])

    # Text first, types in a second step: a parser reads its value several times over.
    def cell(index: int, name: str):
        position = F.get("_places", F.lit(index))
        return nulled(F.when(position > 0, F.get("_cells", position - 1)), EXPORT_NULLS).alias(name)

    text = cells.select(*[cell(i, f.name) for i, f in enumerate(schema)])
    typed = {"timestamp_ntz": offset_to_utc, "int": whole_number, "boolean": flag, "double": number}
    columns = []
    for field in schema:
        parse = typed.get(field.dataType.simpleString(), lambda c: c)
        columns.append(parse(column(field.name)).alias(field.name))
    return text.where(column(key).isNotNull()).select(*columns)


def read_species_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The name-search export that ``operators.joins.species_lookup`` takes."""
    raw = spark.read.options(header=True).csv(path)
    return raw.withColumns({c: trimmed(column(c)) for c in raw.columns})


def scan_table(
    spark: SparkSession, table: str, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """A stored table, optionally restricted to ``{column: value or list}``."""
    return matching(spark.table(table), filters)


def run_sql(
    spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **views: DataFrame
) -> DataFrame:
    """Ad-hoc SQL with named parameters over the session's tables and the given DataFrames
    (referred to as ``{name}``)."""
    return spark.sql(sql, args=dict(args) if args else None, **views)

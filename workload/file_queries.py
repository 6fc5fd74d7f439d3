"""Queries that write the test tables to files or tables in the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skerry.schemas import WEATHER_MEASURES
from skerry.session import shared_folder
from skerry.sinks.loads import (
    create_stored, load_observations, read_stored, replace_window_stored, upsert_stored,
)
from skerry.sinks.tables import export_csv, export_formats, export_parquet, save_table
from skerry.sources.reports import read_ring_records, split_reports
from skerry.sources.tables import read_captures_csv, scan_table
from workload.registry import register
from workload.table_queries import _batch, _report_lines

_COLUMNS = "date time ring_number species_code age weight wing_length fat_score"
_ROWS = "date:d time:f ring_number:s species_code:s age:s weight:f wing_length:i fat_score:i"


def _folder(t, purpose: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _rows(t):
    return t.captures.select(*_COLUMNS.split())


# ---------------------------------------------------------------- files


def _csv(t):
    folder = _folder(t, "captures-csv")
    export_csv(_rows(t), folder)
    return read_captures_csv(t.spark, folder)


def _parquet(t):
    folder = _folder(t, "captures-parquet")
    export_parquet(_rows(t), folder, ["age"])
    return t.spark.read.parquet(folder)


def _formats(t):
    base, rows = _folder(t, "captures"), _rows(t)
    formats = ("parquet", "csv", "json")
    export_formats(rows, base, formats)
    found = None
    for name in formats:
        part = t.spark.read.schema(rows.schema).options(**({"header": "true"} if name == "csv" else {})).format(name).load(
            f"{base}.{name}").withColumn("format", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


register("csv_round_trip", _ROWS, _csv, "captures", f"SELECT {_COLUMNS.replace(' ', ', ')} FROM captures")
register("parquet_export", _ROWS, _parquet, "captures", f"SELECT {_COLUMNS.replace(' ', ', ')} FROM captures")
register("formats_export", f"format:s {_ROWS}", _formats, "captures", f"""
        SELECT format, {_COLUMNS.replace(' ', ', ')} FROM captures,
               (VALUES ('parquet'), ('csv'), ('json')) AS formats(format)""")

# ---------------------------------------------------------------- tables


def _table(t):
    """Saved, appended to once more, scanned with a filter on the letters that flag an age."""
    table = f"captures_{uuid.uuid4().hex}"
    save_table(_rows(t), table, "fail", sort_by=["species_code", "date"])
    save_table(_rows(t), table, "append")
    return scan_table(t.spark, table, {"age": ["A", "N", "R"]}).groupBy("species_code", "age").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


register("table_sink", "species_code:s age:s n:i weight:f", _table, "captures", """
        SELECT species_code, age, 2 * count(*) AS n, 2 * sum(weight) AS weight
        FROM captures WHERE age IN ('A', 'N', 'R') GROUP BY ALL""")

# ---------------------------------------------------------------- stored loads


def _upserted(t):
    table = f"observations_{uuid.uuid4().hex}"
    create_stored(t.observations, table, "StartDate")
    upsert_stored(_batch(t), table, order=[F.col("price")])
    return read_stored(t.spark, table)


def _window_replaced(t):
    """Weather of a year by month; the batch covers a part of two months and those between."""
    table = f"weather_{uuid.uuid4().hex}"
    create_stored(t.weather_a_year.select("observation_time", *WEATHER_MEASURES), table, "observation_time")
    replace_window_stored(t.weather_b_year.select("observation_time", *WEATHER_MEASURES).where(
        F.col("observation_time").between("2024-04-10", "2024-08-20") & (F.hour("observation_time") % 2 == 0)), table)
    return read_stored(t.spark, table)


def _loaded(t):
    """Observations in a table that lacks most columns by now; then every fourth comes anew, whole."""
    table = f"observations_{uuid.uuid4().hex}"
    create_stored(t.observations.select("OccurrenceId", "StartDate"), table, "StartDate")
    load_observations(t.observations.where(F.col("OccurrenceId").cast("bigint") % 4 == 0), table)
    return read_stored(t.spark, table).withColumn("fetched", F.col("fetched_at").isNotNull())


register("stored_upsert", "OccurrenceId:s StartDate:t DataProviderId:i price:f", _upserted, "observations", """
        SELECT * REPLACE (price + if(CAST("OccurrenceId" AS BIGINT) % 4 = 0, 1, 0) AS price)
        FROM observations
        UNION ALL
        SELECT * REPLACE ('n' || "OccurrenceId" AS "OccurrenceId")
        FROM observations WHERE CAST("OccurrenceId" AS BIGINT) % 10 = 0""")
_HOURLY = ", ".join(WEATHER_MEASURES)
register("stored_replace_window", "observation_time:t " + " ".join(f"{m}:f" for m in WEATHER_MEASURES),
         _window_replaced, "weather_a_year weather_b_year", f"""
        WITH batch AS (SELECT observation_time, {_HOURLY} FROM weather_b_year
                       WHERE observation_time BETWEEN TIMESTAMP '2024-04-10' AND TIMESTAMP '2024-08-20'
                         AND extract(hour FROM observation_time) % 2 = 0)
        SELECT observation_time, {_HOURLY} FROM weather_a_year
        WHERE observation_time < (SELECT min(observation_time) FROM batch)
           OR observation_time > (SELECT max(observation_time) FROM batch)
        UNION ALL SELECT * FROM batch""")
register("stored_schema_evolution", "OccurrenceId:s StartDate:t DyntaxaTaxonId:i DecimalLatitude:f Locality:s fetched:b",
         _loaded, "observations", """
        SELECT "OccurrenceId", "StartDate", if(k % 4 = 0, "DyntaxaTaxonId", NULL) AS "DyntaxaTaxonId",
               if(k % 4 = 0, "DecimalLatitude", NULL) AS "DecimalLatitude", NULL AS "Locality", k % 4 = 0 AS fetched
        FROM (SELECT *, CAST("OccurrenceId" AS BIGINT) AS k FROM observations)""")

# ---------------------------------------------------------------- report files


def _reports(t):
    """A folder of report files for each year, split by route, all their record files read at once."""
    raw, out = _folder(t, "reports"), _folder(t, "split-reports")
    _report_lines(t).write.partitionBy("source_file").text(raw)
    split_reports(t.spark, f"{raw}/*", out)
    # Counted per file first: a path is searched for its year once a file and species, not once a line.
    records = read_ring_records(t.spark, out, fields=("record_type", "species_code", "weight"))
    per_file = records.groupBy("source_file", "record_type", "species_code").agg(
        F.count(F.lit(1)).alias("n"), F.count("weight").alias("weighed"),
        F.sum(F.col("weight").try_cast("double")).alias("weight"))
    year = F.regexp_extract("source_file", "y([0-9]{4})-[0-9a-f]{12}", 1)  # the year's folder with the digest of its path
    return per_file.groupBy(year.alias("year"), "record_type", "species_code").agg(
        *[F.sum(c).alias(c) for c in ("n", "weighed", "weight")])


register("report_files", "year:s record_type:s species_code:s n:i weighed:i weight:f", _reports, "captures", """
        SELECT CAST(year(date) AS VARCHAR) AS year, if(age = 'A', 'C', 'R') AS record_type,
               upper(species_code) AS species_code, count(*) AS n, count(weight) AS weighed, sum(weight) AS weight
        FROM captures GROUP BY ALL""")

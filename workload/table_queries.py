"""Queries for parsing, cleaning, selecting and changing tables.

Where an operator reads text, the text is written out of the test tables by Spark first, so the
work grows with them; the SQL states what has to come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skerry.functions.cleaning import flag, iso_date, number, offset_to_utc, whole_number
from skerry.operators.cleaning import (
    blank_sparse_columns, clean_strings, collate_reports, deduplicate, drop_empty_rows,
)
from skerry.operators.joins import species_lookup
from skerry.operators.selection import (
    adaptive_windows, count_per_period, descendants, label_windows, select_observations,
    window_summary, within_radius,
)
from skerry.schemas import RING_RECORDS, add_missing, enforce_schema
from skerry.sinks.merge import upsert, without_keys
from skerry.sinks.tables import with_audit_columns, with_record_ids
from skerry.sources.lines import decode_lines, unfold
from skerry.sources.reports import FIELDS, parse_data_lines, route_lines
from skerry.sources.station import read_station_export
from skerry.session import shared_folder
from skerry.sources.tables import read_observation_export, run_sql
from workload.registry import register

# ---------------------------------------------------------------- ring reports


def _report_lines(t):
    """Captures as report lines of one file per year: 35 fields, most of them unused."""
    year = F.year("date")
    values = {
        "record_type": F.when(F.col("age") == "A", "C").otherwise("R"),
        "ring_number": F.col("ring_number"),
        "scheme": F.when(F.col("fat_score") == 7, "OTH").otherwise("SCH"),
        "station_code": F.lit("1"),
        "station_name": F.when(F.col("wing_length") > 45, "ELSEWHERE").otherwise("HERE"),
        "age_code": F.col("age_code"),
        "date": F.when(F.col("fat_score") == 6, "n.d.").otherwise(F.col("date").cast("string")),
        "time": F.floor("time").cast("string"),
        "species_code": F.upper("species_code"), "ringer": F.col("ringer"),
        "age": F.col("age"), "wing_length": F.col("wing_length").cast("string"),
        "weight": F.coalesce(F.col("weight").cast("string"), F.lit("NA")),
        "fat_score": F.col("fat_score").cast("string"), "muscle_score": F.lit("broken"),
        # One capture in seven has a brood patch, too few to keep, except in 1999.
        "brood_patch": F.when((year == 1999) | (F.col("fat_score") == 1), F.lit("2")),
        "moult_score": F.when(F.col("fat_score") <= 3, F.lit("3.5")),
        "notes": F.when(F.col("fat_score").between(2, 6), F.concat(F.lit('"a|b ""'), "age", F.lit('"""'))),
    }
    fields = [
        F.coalesce(values[FIELDS[i]], F.lit("")) if i in FIELDS else F.lit("") for i in range(35)
    ]
    return unfold(t.captures, [
        F.concat(F.lit("y"), year).alias("source_file"), F.concat_ws("|", *fields).alias("value")])


_REPORT = " ".join(f"{name}:s" for name in FIELDS.values())
_REPORT_SQL = """
        SELECT 'y' || year(date) AS source_file, if(age = 'A', 'C', 'R') AS record_type,
               ring_number, if(fat_score = 7, 'OTH', 'SCH') AS scheme, '1' AS station_code,
               if(wing_length > 45, 'ELSEWHERE', 'HERE') AS station_name, age_code,
               if(fat_score = 6, 'n.d.', CAST(date AS VARCHAR)) AS date,
               CAST(CAST(floor(time) AS INTEGER) AS VARCHAR) AS time,
               upper(species_code) AS species_code, ringer, age,
               CAST(wing_length AS VARCHAR) AS wing_length, CAST(weight AS VARCHAR) AS weight,
               CAST(fat_score AS VARCHAR) AS fat_score, 'broken' AS muscle_score,
               if(year(date) = 1999 OR fat_score = 1, '2', NULL) AS brood_patch,
               if(fat_score <= 3, '3.5', NULL) AS moult_score,
               if(fat_score BETWEEN 2 AND 6, 'a|b "' || age || '"', NULL) AS notes
        FROM captures"""
register("report_fields", f"source_file:s {_REPORT}",
         lambda t: parse_data_lines(_report_lines(t)), "captures", _REPORT_SQL)

_TAGS = ["Q", "M", "H", "S", "L", "C", "R", "X", " "]
register("report_routes", "route:s lines:i first:s last:s",
         lambda t: route_lines(t.captures.select(F.concat(
             F.element_at(F.array(*[F.lit(tag) for tag in _TAGS]),
                          F.col("wing_length") % len(_TAGS) + 1),
             F.when(F.col("wing_length") % len(_TAGS) == 8, "  ").otherwise(F.col("ring_number")),
         ).alias("value"))).groupBy("route").agg(
             F.count(F.lit(1)).alias("lines"), F.min("value").alias("first"),
             F.max("value").alias("last")), "captures", """
        SELECT CASE wing_length % 9 WHEN 0 THEN 'meta_header' WHEN 1 THEN 'meta_station'
                    WHEN 3 THEN 'meta_ringer_initials' WHEN 4 THEN 'meta_locations'
                    ELSE 'ring_records' END AS route,
               count(*) AS lines, min(line) AS first, max(line) AS last
        FROM (SELECT *, substr('QMHSLCRX', wing_length % 9 + 1, 1) || ring_number AS line
              FROM captures WHERE wing_length % 9 NOT IN (2, 7, 8))
        GROUP BY 1""")


def _species_names(t):
    """Brands as a name-search export, in lower case and with many repeats; those above 20 under
    terms that no species has."""
    number_of = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    term = F.concat(F.when(number_of > 20, "z").otherwise(""), F.lower("p_brand"))
    return t.raw("part").select(
        term.alias("Sökträff"), F.lit("k").alias("Namnkategori"),
        F.concat(F.lit("sci "), "p_brand").alias("Vetenskapligt namn"), F.lit("a").alias("Auktor"),
        F.concat(F.lit("name "), "p_brand").alias("Svenskt namn"),
        F.lit("Art").alias("Taxonkategori"), number_of.cast("double").alias("TaxonID"))


_NAMES_SQL = """
        SELECT DISTINCT if(CAST(split_part(p_brand, '#', 2) AS INTEGER) > 20, 'Z', '')
                   || upper(p_brand) AS species_code, 'sci ' || p_brand AS scientific_name,
               'name ' || p_brand AS swedish_name,
               CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS "TaxonID"
        FROM part"""
register("species_lookup",
         "species_code:s n:i scientific_name:s swedish_name:s TaxonID:f",
         lambda t: species_lookup(
             t.captures.groupBy(F.upper("species_code").alias("species_code")).agg(
                 F.count(F.lit(1)).alias("n")), _species_names(t)), "captures", f"""
        SELECT * FROM (SELECT upper(species_code) AS species_code, count(*) AS n FROM captures
                       GROUP BY 1) LEFT JOIN ({_NAMES_SQL}) USING (species_code)""")
register("collate_reports",
         "date:d time:f record_type:s ring_number:s age_code:s species_code:s ringer:s age:s "
         "wing_length:f weight:f fat_score:f muscle_score:f brood_patch:f moult_score:f notes:s "
         "scientific_name:s swedish_name:s TaxonID:f",
         lambda t: collate_reports(
             parse_data_lines(_report_lines(t)), "SCH", "HERE", _species_names(t)),
         "captures", f"""
        WITH r AS (
            SELECT *, 10 * (n - count(brood_patch) OVER f) < 7 * n AS keep_brood,
                   10 * (n - count(moult_score) OVER f) < 7 * n AS keep_moult
            FROM (SELECT *, count(*) OVER (PARTITION BY source_file) AS n FROM ({_REPORT_SQL}))
            WINDOW f AS (PARTITION BY source_file)),
        u AS (
            SELECT DISTINCT try_cast(date AS DATE) AS date, CAST(time AS DOUBLE) AS time,
                   record_type, ring_number, age_code, species_code, ringer, age,
                   CAST(wing_length AS DOUBLE) AS wing_length, CAST(weight AS DOUBLE) AS weight,
                   CAST(fat_score AS DOUBLE) AS fat_score, CAST(NULL AS DOUBLE) AS muscle_score,
                   CAST(if(keep_brood, brood_patch, NULL) AS DOUBLE) AS brood_patch,
                   CAST(if(keep_moult, moult_score, NULL) AS DOUBLE) AS moult_score, notes
            FROM r WHERE scheme = 'SCH' AND station_name = 'HERE')
        SELECT * FROM u LEFT JOIN ({_NAMES_SQL}) USING (species_code)""")

# ---------------------------------------------------------------- station and public exports


def _station_files(t):
    """Readings as a file for each hour of the day, read back. What is before the header, a line
    that looks like a reading among it, is no reading; another header further down changes nothing."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/stations-{uuid.uuid4().hex}"
    hour = F.date_format("observation_time", "HH").alias("file")
    reading = F.concat_ws(
        ";", F.date_format("observation_time", "yyyy-MM-dd"),
        F.date_format("observation_time", "HH:mm:ss"),
        F.when(F.col("humidity") == 2, "-").otherwise(F.col("temperature").cast("string")),
        F.when(F.col("humidity") > 1, F.col("temperature_quality")))
    header = "Datum;Tid (UTC);Lufttemperatur;Kvalitet"
    above = ["Stationsnamn;Nummer", "Station;12", "2001-01-01;00:00:00;99.9;G", "", header]
    lines = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(v).alias("value")) for i, v in enumerate(above)])
    readings = t.weather_a.select(hour, F.dayofmonth("observation_time").alias("day"), reading.alias("value")).select(
        "file", (F.col("day") + 9).alias("place"), "value")
    heads = readings.select("file").distinct().select("file", F.inline(lines))
    again = readings.select("file").distinct().select("file", F.lit(20).alias("place"), F.lit(header).alias("value"))
    readings.unionByName(heads).unionByName(again).repartition("file").sortWithinPartitions(
        "file", "place").drop("place").write.partitionBy("file").text(folder)
    return read_station_export(t.spark, folder, "temperature")


register("station_export", "observation_time:t temperature:f temperature_quality:s",
         _station_files, "weather_a", """
        SELECT observation_time, if(humidity = 2, NULL, temperature) AS temperature,
               if(humidity > 1, temperature_quality, NULL) AS temperature_quality
        FROM weather_a""")


#: Range of keys that share the four export files of a provider.
_PIECE_KEYS = 1 << 20


def _export_lines(t):
    """Observations as the lines of tab-separated files, some per provider; provider 2 turns the
    columns round. Fields have tabs, line ends and quotes; some equal the name of a column."""
    key = F.col("OccurrenceId").cast("bigint")
    day = F.date_format("StartDate", "yyyy-MM-dd")
    cells = {
        "OccurrenceId": F.col("OccurrenceId"),
        "StartDate": F.concat(day, F.lit("T06:30:00+02:00")),
        "EndDate": F.concat(day, F.when(key % 2 == 0, "T06:30:00Z").otherwise("T99:30:00Z")),
        "DecimalLatitude": F.col("DecimalLatitude").cast("string"),
        "DyntaxaTaxonId": F.when(key % 5 == 0, "x1").otherwise(
            F.col("DyntaxaTaxonId").cast("string")),
        "Locality": F.element_at(
            F.array(F.lit("null"), F.lit("NULL"), F.lit(""), F.lit("Ö"), F.lit('"N"')),
            (key % 5 + 1).cast("int")),
        "Verified": F.element_at(
            F.array(F.lit("true"), F.lit("False"), F.lit("maybe")), (key % 3 + 1).cast("int")),
        "RecordedBy": F.when(key % 11 == 0, "OccurrenceId").otherwise('"r"'),
        "OccurrenceRemarks": F.element_at(
            F.array(*[F.lit(v) for v in ('"tab\there"', '"two\n\nlines"', '"say ""hi"""', 'a"b"', '"\n"')]),
            (key % 5 + 1).cast("int")),
    }
    names, turned = list(cells), list(reversed(cells))

    def line(order, suffix):
        return F.concat(F.concat_ws("\t", *[cells[c] for c in order]), suffix)

    # Four pieces for each range of keys: files keep their size, more rows make more of them.
    piece = F.floor(key / _PIECE_KEYS) * 4 + F.floor(key / 32) % 4
    rows = t.observations.select(
        F.col("DataProviderId").cast("string").alias("provider"), piece.alias("piece"),
        F.lit(1).alias("place"), F.when(F.col("DataProviderId") == 2, line(turned, F.lit(""))).otherwise(
            line(names, F.when(key % 7 == 0, "\tragged").otherwise(""))).alias("value"))
    header = F.when(F.col("provider") == "2", "\t".join(turned)).otherwise("\t".join(names))
    headers = rows.select("provider", "piece").distinct().withColumns({"place": F.lit(0), "value": header})
    return rows.unionByName(headers)


def _export_files(t):
    """Those lines written to a file for each provider and piece, header first, and read back."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    by = ["provider", "piece"]
    _export_lines(t).repartition(*by).sortWithinPartitions(*by, "place").drop("place").write.partitionBy(*by).text(folder)
    return read_observation_export(t.spark, folder)


register("observation_export",
         "OccurrenceId:s StartDate:t EndDate:t DecimalLatitude:f DyntaxaTaxonId:i Locality:s "
         "Verified:b Municipality:s RecordedBy:s OccurrenceRemarks:s",
         _export_files, "observations", """
        SELECT "OccurrenceId", date_trunc('day', "StartDate") + INTERVAL 270 MINUTE AS "StartDate",
               if(k % 2 = 0, date_trunc('day', "StartDate") + INTERVAL 390 MINUTE, NULL)
                   AS "EndDate",
               "DecimalLatitude", if(k % 5 = 0, NULL, "DyntaxaTaxonId") AS "DyntaxaTaxonId",
               [NULL, NULL, NULL, 'Ö', 'N'][k % 5 + 1] AS "Locality",
               [true, false, NULL][k % 3 + 1] AS "Verified", NULL AS "Municipality",
               if(k % 11 = 0, 'OccurrenceId', 'r') AS "RecordedBy",
               ['tab' || chr(9) || 'here', 'two' || chr(10) || chr(10) || 'lines', 'say "hi"', 'a"b"',
                chr(10)][k % 5 + 1] AS "OccurrenceRemarks"
        FROM (SELECT *, CAST("OccurrenceId" AS BIGINT) AS k FROM observations)""")


def _mixed_encodings(t):
    """Customer names per market segment: two segments are not UTF-8, one not windows-1252."""
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    tail = (
        F.when(segment == "BUILDING", F.unhex(F.lit("E980")))
        .when((segment == "MACHINERY") & (F.col("c_custkey") % 2 == 0), F.unhex(F.lit("81")))
        .otherwise(F.lit("é€").cast("binary"))
    )
    return t.raw("customer").select(
        segment.alias("source_file"),
        F.concat(name.cast("binary"), tail).cast("string").alias("value"))


register("decode_lines", "source_file:s value:s",
         lambda t: decode_lines(_mixed_encodings(t)), "", """
        SELECT c_mktsegment AS source_file, c_name || CASE
                   WHEN c_mktsegment = 'BUILDING' THEN 'é€'
                   WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0 THEN chr(129)
                   WHEN c_mktsegment = 'MACHINERY'
                       THEN chr(195) || chr(169) || chr(226) || chr(130) || chr(172)
                   ELSE 'é€' END AS value
        FROM customer""")

# ---------------------------------------------------------------- cleaning

register("clean_strings", "date:d species_code:s ringer:s age:s weight:f",
         lambda t: clean_strings(t.captures.select(
             F.when(F.col("fat_score") == 1, "soon").otherwise(
                 F.concat(F.lit(" "), F.col("date").cast("string"))).alias("date"),
             F.concat(F.lit("\t "), "species_code", F.lit("  ")).alias("species_code"),
             F.when(F.col("age") == "A", "   ").otherwise(F.col("ringer")).alias("ringer"),
             F.when(F.col("age") == "R", "").otherwise(F.col("age")).alias("age"), "weight")),
         "captures", """
        SELECT if(fat_score = 1, NULL, date) AS date, species_code,
               if(age = 'A', NULL, ringer) AS ringer, nullif(age, 'R') AS age, weight
        FROM captures""")


def _text_values(t):
    key = F.col("o_orderkey")
    return t.raw("orders").select(
        key.alias("key"),
        F.when(key % 4 == 0, "2020-13-01").otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(key % 3 == 0, "12,5").otherwise(F.col("o_totalprice").cast("string")).alias("num"),
        F.when(key % 5 == 0, "7x").otherwise(F.col("o_custkey").cast("string")).alias("int"),
        F.when(key % 2 == 0, "TRUE").when(key % 3 == 0, "no").otherwise("false").alias("flag"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(
            key % 2 == 0, "T00:15:00+0130").otherwise("T23:45:00-05:00")).alias("moment"))


register("lenient_casts", "key:i day:d num:f int:i flag:b moment:t",
         lambda t: _text_values(t).select(
             "key", iso_date(F.col("day")).alias("day"), number(F.col("num")).alias("num"),
             whole_number(F.col("int")).alias("int"), flag(F.col("flag")).alias("flag"),
             offset_to_utc(F.col("moment")).alias("moment")), "", """
        SELECT o_orderkey AS key, if(o_orderkey % 4 = 0, NULL, o_orderdate) AS day,
               if(o_orderkey % 3 = 0, NULL, o_totalprice) AS num,
               if(o_orderkey % 5 = 0, NULL, o_custkey) AS int,
               CASE WHEN o_orderkey % 2 = 0 THEN true WHEN o_orderkey % 3 > 0 THEN false END
                   AS flag,
               o_orderdate + to_minutes(if(o_orderkey % 2 = 0, -75, 1725)) AS moment
        FROM orders""")
register("sparse_columns", "species_code:s n:i rare:i half:i",
         lambda t: blank_sparse_columns(
             t.captures.select(
                 "species_code",
                 F.when((F.col("fat_score") == 1) | (F.col("species_code") == "Brand#7"), 1)
                 .alias("rare"),
                 F.when(F.col("fat_score") <= 3, 1).alias("half")),
             ["rare", "half"], "species_code").groupBy("species_code").agg(
                 F.count(F.lit(1)).alias("n"), F.count("rare").alias("rare"),
                 F.count("half").alias("half")), "captures", """
        SELECT species_code, n, if(10 * (n - rare) < 7 * n, rare, 0) AS rare,
               if(10 * (n - half) < 7 * n, half, 0) AS half
        FROM (SELECT species_code, count(*) AS n,
                     count_if(fat_score = 1 OR species_code = 'Brand#7') AS rare,
                     count_if(fat_score <= 3) AS half
              FROM captures GROUP BY ALL)""")
register("sparse_columns_overall", "n:i rare:i half:i",
         lambda t: blank_sparse_columns(
             t.captures.select(
                 F.when(F.col("fat_score") == 1, 1).alias("rare"),
                 F.when(F.col("fat_score") <= 3, 1).alias("half")), ["rare", "half"]).agg(
                     F.count(F.lit(1)).alias("n"), F.count("rare").alias("rare"),
                     F.count("half").alias("half")), "captures", """
        SELECT count(*) AS n, 0 AS rare, count_if(fat_score <= 3) AS half FROM captures""")
register("dedup_rows", "ring_number:s fat_score:i age:s",
         lambda t: deduplicate(drop_empty_rows(
             t.captures.select("ring_number", "fat_score", "age"))), "captures",
         "SELECT ring_number, fat_score, age FROM captures GROUP BY ALL")

# ---------------------------------------------------------------- selection

_DISTANCE_SQL = """2 * 6371008.8 * asin(sqrt(
                   sin(radians("DecimalLatitude" - 57.3025) / 2) ** 2
                   + cos(radians("DecimalLatitude")) * cos(radians(57.3025))
                     * sin(radians("DecimalLongitude" - 11.90056) / 2) ** 2))"""
_OBSERVATION = "OccurrenceId:s StartDate:t EndDate:t DyntaxaTaxonId:i DataProviderId:i"
register("within_radius", _OBSERVATION,
         lambda t: within_radius(t.observations), "observations",
         f"SELECT * FROM observations WHERE {_DISTANCE_SQL} <= 5000")
register("taxon_descendants", "taxon_id:i",
         lambda t: descendants(t.taxonomy, 3), "taxonomy", """
        WITH RECURSIVE below AS (
            SELECT taxon_id FROM taxonomy WHERE taxon_id = 3 OR parent_id = 3
            UNION SELECT x.taxon_id FROM taxonomy AS x JOIN below ON x.parent_id = below.taxon_id)
        SELECT taxon_id FROM below""")
register("select_observations", _OBSERVATION,
         lambda t: select_observations(
             t.observations, "1996-01-01", "2000-12-31", taxa=descendants(t.taxonomy, 3)),
         "observations", f"""
        SELECT * FROM observations
        WHERE {_DISTANCE_SQL} <= 5000 AND "StartDate" >= DATE '1996-01-01'
          AND "EndDate" < DATE '2001-01-01' AND "DataProviderId" = 1
          AND "DyntaxaTaxonId" IN (3, 6, 7, 12, 13, 14, 15, 24, 25, 26, 27, 28, 29, 30, 31,
                                   48, 49)""")
register("count_per_period", "period:d n:i",
         lambda t: count_per_period(
             within_radius(t.observations), F.trunc(F.col("StartDate"), "MONTH")),
         "observations", f"""
        SELECT date_trunc('month', "StartDate") AS period, count(*) AS n
        FROM observations WHERE {_DISTANCE_SQL} <= 5000 GROUP BY 1""")
_WINDOWED_SQL = """
        SELECT *, CASE WHEN c <= 200 THEN 'chunk' WHEN y <= 200 THEN 'year'
                       WHEN m <= 200 THEN 'month' ELSE 'day' END AS level
        FROM (SELECT day, chunk,
                     count(*) OVER (PARTITION BY chunk) AS c,
                     count(*) OVER (PARTITION BY year(day)) AS y,
                     count(*) OVER (PARTITION BY year(day), month(day)) AS m,
                     count(*) OVER (PARTITION BY day) AS d
              FROM (SELECT CAST("StartDate" AS DATE) AS day,
                           1950 + (year("StartDate") - 1950) // 10 * 10 AS chunk
                    FROM observations))"""
_START_SQL = """CASE level WHEN 'chunk' THEN make_date(chunk, 1, 1)
                           WHEN 'year' THEN make_date(year(day), 1, 1)
                           WHEN 'month' THEN date_trunc('month', day) ELSE day END"""
register("adaptive_windows", "level:s window_start:d window_end:d n_rows:i",
         lambda t: window_summary(adaptive_windows(t.observations, limit=200)),
         "observations", f"""
        SELECT level, {_START_SQL} AS window_start,
               CASE level WHEN 'chunk' THEN make_date(chunk + 9, 12, 31)
                          WHEN 'year' THEN make_date(year(day), 12, 31)
                          WHEN 'month' THEN last_day(day) ELSE day END AS window_end,
               count(*) AS n_rows
        FROM ({_WINDOWED_SQL}) GROUP BY 1, 2, 3""")
register("label_windows", "window_id:s n:i price:f",
         lambda t: label_windows(
             t.observations, adaptive_windows(t.observations, limit=200)
         ).groupBy("window_id").agg(
             F.count(F.lit(1)).alias("n"), F.max("price").alias("price")), "observations", f"""
        SELECT level || ':' || CAST(CAST({_START_SQL} AS DATE) AS VARCHAR) AS window_id,
               count(*) AS n, max(price) AS price
        FROM ({_WINDOWED_SQL.replace('SELECT day, chunk,', 'SELECT day, chunk, price,').replace(
            '1950 + (year', 'price, 1950 + (year')}) GROUP BY 1""")

# ---------------------------------------------------------------- tables

register("sql_passthrough", "species_code:s n:i mean_weight:f",
         lambda t: run_sql(
             t.spark, "SELECT species_code, count(*) AS n, avg(weight) AS mean_weight "
             "FROM {captures} WHERE age = :age GROUP BY species_code", {"age": "A"},
             captures=t.captures), "captures", """
        SELECT species_code, count(*) AS n, avg(weight) AS mean_weight
        FROM captures WHERE age = 'A' GROUP BY ALL""")
register("enforce_schema",
         "date:d time:f species_code:s wing_length:i weight:f muscle_score:i created_at:t",
         lambda t: enforce_schema(
             t.captures.select(
                 F.col("wing_length").cast("string").alias("wing_length"),
                 F.when(F.col("age") == "A", "heavy").otherwise(
                     F.col("weight").cast("string")).alias("weight"),
                 F.when(F.col("fat_score") == 2, "never").otherwise(
                     F.col("date").cast("string")).alias("date"),
                 "time", "species_code", "ringer"), RING_RECORDS), "captures", """
        SELECT date, time, species_code, wing_length, if(age = 'A', NULL, weight) AS weight,
               NULL AS muscle_score, CAST(NULL AS TIMESTAMP) AS created_at
        FROM captures WHERE fat_score <> 2""")
register("schema_evolution", "age:s weight:f notes:s n:i",
         lambda t: add_missing(t.captures.drop("weight").where("age = 'A'"), RING_RECORDS)
         .unionByName(t.captures.where("age <> 'A'"), allowMissingColumns=True)
         .groupBy("age", "weight", "notes").agg(F.count(F.lit(1)).alias("n")), "captures", """
        SELECT age, if(age = 'A', NULL, weight) AS weight, NULL AS notes, count(*) AS n
        FROM captures GROUP BY ALL""")
register("record_ids", "n:i first:i last:i distinct_ids:i weight:f",
         lambda t: with_record_ids(t.captures.select("weight"), 100).agg(
             F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"),
             F.max("record_id").alias("last"),
             F.count_distinct("record_id").alias("distinct_ids"),
             F.sum("weight").alias("weight")), "captures", """
        SELECT count(*) AS n, 101 AS first, 100 + count(*) AS last, count(*) AS distinct_ids,
               sum(weight) AS weight FROM captures""")
register("audit_columns", "data_source:s station_id:i n:i stamped:i",
         lambda t: with_audit_columns(
             t.captures.select("date"), data_source="CSV", station_id=7).groupBy(
                 "data_source", "station_id").agg(
                     F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("created_at") == F.col("updated_at")).alias("stamped")),
         "captures", """
        SELECT 'CSV' AS data_source, 7 AS station_id, count(*) AS n, count(*) AS stamped
        FROM captures""")


def _batch(t):
    """Every fourth observation twice, dearer the second time, and a new one for every tenth."""
    key, seen = F.col("OccurrenceId").cast("bigint"), t.observations
    old = seen.where(key % 4 == 0)
    new = seen.where(key % 10 == 0).withColumn(
        "OccurrenceId", F.concat(F.lit("n"), "OccurrenceId"))
    dearer = old.withColumn("price", F.col("price") + 1)
    return old.unionByName(dearer).unionByName(new).withColumn("extra", F.lit("dropped"))


register("upsert", "OccurrenceId:s StartDate:t DataProviderId:i price:f",
         lambda t: upsert(t.observations, _batch(t), order=[F.col("price")]), "observations", """
        SELECT * REPLACE (price + if(CAST("OccurrenceId" AS BIGINT) % 4 = 0, 1, 0) AS price)
        FROM observations
        UNION ALL
        SELECT * REPLACE ('n' || "OccurrenceId" AS "OccurrenceId")
        FROM observations WHERE CAST("OccurrenceId" AS BIGINT) % 10 = 0""")
register("without_keys", "OccurrenceId:s price:f",
         lambda t: without_keys(t.observations, _batch(t), "OccurrenceId"), "observations",
         'SELECT * FROM observations WHERE CAST("OccurrenceId" AS BIGINT) % 4 <> 0')

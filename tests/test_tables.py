"""Text fixtures through the readers, and table changes through the writers."""

import datetime as dt
import itertools
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from skerry.operators.cleaning import (
    blank_sparse_columns, clean_strings, collate_reports, drop_empty_columns, drop_empty_rows,
)
from skerry.operators.selection import adaptive_windows, label_windows, window_summary
from skerry.schemas import OBSERVATIONS, RING_RECORDS, WEATHER, add_missing, enforce_schema
from skerry.schemas import in_both, needs_rebuild
from skerry.sinks import tables as sinks
from skerry.sinks.merge import replace_window, upsert
from skerry.sources.lines import cut_quoted, decode_lines, read_lines, split_quoted, unquoted
from skerry.sources.reports import FIELDS, read_ring_records, split_reports
from skerry.sources.station import read_station_export
from skerry.sources.tables import (
    read_captures_csv, read_observation_export, read_species_names, run_sql, scan_table,
)


def data_line(**values):
    cells = [""] * 36
    known = {
        "record_type": "C", "ring_number": "1", "scheme": "SCH", "station_name": "HERE",
        "date": "2021-05-01", "time": "7", "species_code": "ABC", "weight": "10.5",
    }
    for position, name in FIELDS.items():
        cells[position] = {**known, **values}.get(name, "")
    return "|".join(cells)


def test_reports_end_to_end(spark, tmp_path):
    year1 = [data_line(), data_line(), data_line(ring_number="2", date="soon", weight="fat"),
             data_line(scheme="OTH"), data_line(station_name="ELSEWHERE")]
    year2 = [data_line(), data_line(ring_number="3", notes="seen", species_code="XYZ"),
             data_line(ring_number="4", notes='"a ""b""|c"'), ""]
    (tmp_path / "site-2020.txt").write_text(
        "\n".join(["Qheader", "Mstation", "Hsecret person", "", "Sinitials", *year1]))
    (tmp_path / "site-2021.txt").write_text("\n".join(["Lplace", "?odd", *year2]))
    out = str(tmp_path / "split")
    split_reports(spark, f"{tmp_path}/site-*.txt", out)
    routed = spark.read.text(out)
    assert routed.where(F.col("value").contains("secret")).isEmpty()
    assert {(r.report, r.route) for r in routed.select("report", "route").distinct().collect()} == {
        ("site-2020", "meta_header"), ("site-2020", "meta_station"),
        ("site-2020", "meta_ringer_initials"), ("site-2020", "ring_records"),
        ("site-2021", "meta_locations"), ("site-2021", "ring_records")}
    names = tmp_path / "names.csv"
    names.write_text("Sökträff,Namnkategori,Vetenskapligt namn,Auktor,Svenskt namn,Taxonkategori,"
                     "TaxonID\nabc,k,Sci,a,Swe,Art,7\nabc,k,Sci,a,Swe,Art,7\n")
    raw = read_ring_records(spark, out)
    assert read_ring_records(spark, out, "site-2021").count() == 3
    clean = collate_reports(raw, "SCH", "HERE", read_species_names(spark, str(names)))
    assert sorted((r.ring_number, str(r.date), r.weight, r.swedish_name, r.notes)
                  for r in clean.collect()) == [
        ("1", "2021-05-01", 10.5, "Swe", None), ("2", "None", None, "Swe", None),
        ("3", "2021-05-01", 10.5, None, "seen"), ("4", "2021-05-01", 10.5, "Swe", 'a "b"|c')]


def test_station_export(spark, tmp_path):
    good = tmp_path / "t.csv"
    good.write_text("Stationsnamn;Station\nX;1\n\nDatum;Tid (UTC);Lufttemperatur;Kvalitet;;Note\n"
                    "2020-01-01;06:00:00;-1.5;G;;x\n2020-01-01;07:00:00;n/a;Y\n2020-01-01;8;1;G\n"
                    "2020-01-01;09:00:00;2\n")
    rows = read_station_export(spark, str(good), "temperature").collect()
    assert [(r.observation_time.hour, r.temperature, r.temperature_quality) for r in rows] == [
        (6, -1.5, "G"), (7, None, "Y"), (9, 2.0, None)]
    empty = tmp_path / "e.csv"
    empty.write_text("Datum;Tid (UTC);Lufttemperatur;Kvalitet\n")
    frame = read_station_export(spark, str(empty), "temperature")
    assert frame.isEmpty() and frame.schema["temperature"].dataType.typeName() == "double"
    bad = tmp_path / "b.csv"
    bad.write_text("nothing;here\n")
    with pytest.raises(ValueError):
        read_station_export(spark, str(bad), "temperature")


def test_observation_exports_with_different_headers_and_encodings(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes((
        "﻿OccurrenceId\tStartDate\tLocality\tWeight\tVerified\tExtra\n"
        "u:1\t2023-04-15T06:00:00+02:00\tGöteborg\t12\tTrue\tx\n"
        "u:2\t2023-09-03T08:30:00+0200\tNULL\theavy\tmaybe\tx\tragged\n").encode("utf-8"))
    (tmp_path / "b.tsv").write_bytes(
        "Locality\tOccurrenceId\nMalmö – €\tu:3\n".encode("windows-1252"))
    (tmp_path / "c.tsv").write_bytes(b"")
    frame = read_observation_export(spark, f"{tmp_path}/*.tsv")
    assert frame.columns == OBSERVATIONS.names
    rows = {r.OccurrenceId: r for r in frame.collect()}
    assert set(rows) == {"u:1", "u:2", "u:3"}
    assert rows["u:1"].StartDate == dt.datetime(2023, 4, 15, 4)
    assert rows["u:2"].StartDate == dt.datetime(2023, 9, 3, 6, 30)
    assert (rows["u:1"].Locality, rows["u:1"].Weight, rows["u:1"].Verified) == (
        "Göteborg", 12, True)
    assert (rows["u:2"].Locality, rows["u:2"].Weight, rows["u:2"].Verified) == (None, None, None)
    assert rows["u:3"].Locality == "Malmö – €"


def test_observation_exports_with_quoted_fields(spark, tmp_path):
    head = "OccurrenceId\tLocality\tRecordedBy\tOccurrenceRemarks\n"
    (tmp_path / "a.tsv").write_text(
        "\n" + head + '1\t"tab\there"\t"say ""hi"""\tplain\n2\t"two\nlines, ""q"" \n\nfour"\t""\tx\n'
        + head + '3\tOccurrenceId\t"5\tcm\n"\t"OccurrenceId"\textra\n4\ta"b"\t"c"d\t"\n"\n')
    (tmp_path / "b.tsv").write_text('OccurrenceRemarks\tOccurrenceId\n"OccurrenceId\tx"\t5\n\n\t6\nlone\n')
    rows = {r.OccurrenceId: (r.Locality, r.RecordedBy, r.OccurrenceRemarks)
            for r in read_observation_export(spark, f"{tmp_path}/*.tsv").collect()}
    assert rows == {
        "1": ("tab\there", 'say "hi"', "plain"), "2": ('two\nlines, "q" \n\nfour', None, "x"),
        "OccurrenceId": ("Locality", "RecordedBy", "OccurrenceRemarks"),
        "3": ("OccurrenceId", "5\tcm\n", "OccurrenceId"), "4": ('a"b"', '"c"d', "\n"),
        "5": (None, None, "OccurrenceId\tx"), "6": (None, None, None)}
    (tmp_path / "c.tsv").write_text(head + '1\t"open\t\t\n')
    with pytest.raises(Exception, match="not closed"):
        read_observation_export(spark, f"{tmp_path}/c.tsv").collect()
    (tmp_path / "d.tsv").write_text("Locality\nOccurrenceId\n")
    with pytest.raises(Exception, match="no header line"):
        read_observation_export(spark, f"{tmp_path}/d.tsv").collect()


def test_quoted_records_over_block_borders(spark, tmp_path):
    rng = random.Random(8)
    rows = {}
    for i in range(400):
        rows[str(i)] = rng.choice(["plain", "a\tb", 'q "x" q', "l1\nl2", "\n" * 30, "long\n" * 60, '"', "x" * 200])
    body = "".join(f'{i}\t"{v.replace(chr(34), chr(34) * 2)}"\n' if set(v) & set('\t\n"') else f"{i}\t{v}\n" for i, v in rows.items())
    (tmp_path / "x.tsv").write_text("OccurrenceId\tOccurrenceRemarks\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        frame = read_observation_export(spark, str(tmp_path / "x.tsv"))
        assert frame.rdd.getNumPartitions() > 1
        assert {r.OccurrenceId: r.OccurrenceRemarks for r in frame.collect()} == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_fields_of_any_length(spark):
    cells = ["", 'a"b', "x|y", '"', "q" * 100_000, '""' * 20_000, "é|\n", '"a"b']
    line = "|".join('"' + c.replace('"', '""') + '"' if i % 2 else c.replace("|", "") for i, c in enumerate(cells))
    row = spark.createDataFrame([(line,), ("a|b||",), ("",), ("|",), ('"',), ('"a|b',)], "v string").select(split_quoted(F.col("v"), "|").alias("f")).collect()
    want = [c if i % 2 else c.replace("|", "") for i, c in enumerate(cells)]
    assert [r.f for r in row] == [want, ["a", "b", "", ""], [""], ["", ""], ['"'], ['"a', "b"]]


def test_fields_cut_apart_are_those_of_the_whole_record(spark):
    marks = [b"", b'"', b'""', b"|", b"a", b"\xe9", b"\n", "é😀".encode()]
    values = [bytearray(b"".join(row)) for row in itertools.product(marks, repeat=4)] + [None]
    lines = spark.createDataFrame([(v,) for v in values], "v binary").select(F.col("v").cast("string").alias("v"))
    for separator in ("|", "\t", "é"):
        apart = F.transform(cut_quoted(F.col("v"), separator), unquoted)
        assert lines.where(~apart.eqNullSafe(split_quoted(F.col("v"), separator))).isEmpty()


def test_few_fields_of_reports_are_compiled(spark, tmp_path):
    """A function over the array of fields would take every line through uncompiled code."""
    cells = [f"f{i}" for i in range(35)]
    cells[0], cells[9], cells[18], cells[34] = "C", '"A|""B"', "NA", '"x|y"'
    (tmp_path / "a.b..txt").write_text("|".join(cells) + "\n\nR|1\n")
    split_reports(spark, f"{tmp_path}/*.txt", f"{tmp_path}/out")
    few = read_ring_records(spark, f"{tmp_path}/out", "a.b.", ["weight", "species_code", "record_type"])
    assert few.columns == ["source_file", "record_type", "species_code", "weight"]
    rows = {tuple(r)[1:] for r in few.collect()}
    assert rows == {("C", 'A|"B', None), ("R", None, None)}
    whole = read_ring_records(spark, f"{tmp_path}/out").select("record_type", "species_code", "weight")
    assert {tuple(r) for r in whole.collect()} == rows
    assert "lambda" not in few._jdf.queryExecution().executedPlan().toString()


def test_bytes_windows_1252_lacks_fall_back_to_latin_1(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\x81\xe9\nb\x80\n")
    values = [r.value for r in decode_lines(read_lines(spark, str(tmp_path / "x.txt"))).collect()]
    assert sorted(values) == ["a\x81é", "b\x80"]


def test_captures_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("date,species_code,weight,notes,TaxonID,colour\n2020-05-01,A,1.5,007,3,5\n")
    row = read_captures_csv(spark, str(path), {"colour": "int"}).first()
    assert (row.date, row.weight, row.notes, row.taxon_id, row.colour) == (
        dt.date(2020, 5, 1), 1.5, "007", 3.0, 5)
    assert read_captures_csv(spark, str(path), infer=True).schema["colour"].dataType.typeName() == (
        "integer")


def test_cleaning(spark):
    df = spark.createDataFrame(
        [(" 2020-01-01 ", " a ", None), ("x", "  ", None), (None, None, None)],
        "date string, s string, void string")
    clean = clean_strings(df)
    assert [(r.date, r.s) for r in clean.collect()] == [
        (dt.date(2020, 1, 1), "a"), (None, None), (None, None)]
    assert drop_empty_columns(clean).columns == ["date", "s"]
    assert drop_empty_rows(clean).count() == 1


def test_sparse_columns_are_judged_per_file_and_strictly(spark):
    rows = [("f", 1 if i < 3 else None) for i in range(10)]
    rows += [("g", 1 if i < 4 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "source_file string, v int")
    kept = blank_sparse_columns(df, ["v"], "source_file").groupBy("source_file").agg(
        F.count("v").alias("n"))
    assert dict(kept.collect()) == {"f": 0, "g": 4}  # 70 % null is too sparse, 60 % is not


def test_schema_helpers(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "A", "x"), (None, "A", "1")], "date string, species_code string, weight string")
    shaped = enforce_schema(df, RING_RECORDS)
    assert shaped.columns == RING_RECORDS.names and shaped.count() == 1
    assert shaped.first().weight is None
    assert add_missing(df, WEATHER).columns[:3] == df.columns
    assert in_both(df.withColumn("other", F.lit(1)), RING_RECORDS).columns == df.columns
    assert needs_rebuild(df, "observation_time")


@pytest.fixture
def table(spark):
    name = "t" + uuid.uuid4().hex[:12]
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_tables_append_replace_fail_swap(spark, table):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    sinks.save_table(df, table, "replace", sort_by=["s"])
    sinks.save_table(df, table)
    assert scan_table(spark, table).count() == 4
    assert scan_table(spark, table, {"s": ["a", "c"], "id": 1}).count() == 2
    with pytest.raises(Exception):
        sinks.save_table(df, table, "fail")
    with pytest.raises(ValueError):
        sinks.save_table(df, table, "perhaps")
    sinks.swap_table(spark.table(table).where("id = 1"), table)
    assert spark.table(table).count() == 2
    sinks.refresh_statistics(spark, table)
    counted = run_sql(spark, f"SELECT count(*) AS n FROM {table} WHERE s = :s", {"s": "a"})
    assert counted.first().n == 2


def test_record_ids_continue(spark, table):
    df = enforce_schema(
        spark.range(50).repartition(4).select(
            F.lit("2020-01-01").alias("date"), F.lit("A").alias("species_code"),
            F.col("id").cast("double").alias("weight")), RING_RECORDS)
    sinks.load_captures(df, table, "replace")
    sinks.load_captures(df, table, "append")
    stored = spark.table(table)
    assert sorted(r.record_id for r in stored.collect()) == list(range(1, 101))
    assert stored.where("data_source <> 'CSV' OR created_at IS NULL").isEmpty()
    assert stored.columns == RING_RECORDS.names


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    base = str(tmp_path / "out")
    sinks.export_formats(df, base, ["parquet", "csv", "json"])
    assert spark.read.parquet(f"{base}.parquet").count() == 2
    assert spark.read.option("header", True).csv(f"{base}.csv").columns == ["id", "s"]
    lines = spark.read.text(f"{base}.json").collect()
    assert sorted(json.loads(r.value)["s"] for r in lines) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.export_formats(df, base, ["xlsx"])
    sinks.export_parquet(df, f"{base}-by", ["s"])
    assert (tmp_path / "out-by" / "s=a").is_dir()
    sinks.replace_partitions(df.where("s = 'a'").withColumn("id", F.lit(9)), f"{base}-by", ["s"])
    assert sorted(r.id for r in spark.read.parquet(f"{base}-by").collect()) == [2, 9]


def test_window_replace_drops_unmentioned_hours(spark):
    def at(*hours):
        return spark.createDataFrame(
            [(dt.datetime(2024, 1, 1, h), float(v)) for h, v in hours],
            "observation_time timestamp_ntz, value double")

    target, batch = at((1, 1), (2, 1), (3, 1), (4, 1)), at((2, 9), (4, 9))
    after = replace_window(target, batch)
    assert sorted((r.observation_time.hour, r.value) for r in after.collect()) == [
        (1, 1.0), (2, 9.0), (4, 9.0)]
    assert replace_window(after, batch).count() == 3
    assert replace_window(target, at()).count() == 4


def test_upsert_is_idempotent_and_last_wins(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1)], "OccurrenceId string, v int")
    batch = spark.createDataFrame(
        [("b", 2, 0), ("b", 3, 1), ("c", 4, 0)], "OccurrenceId string, v int, seq int")
    once = upsert(target, batch, order=[F.col("seq")])
    expected = [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, once.collect())) == expected
    assert sorted(map(tuple, upsert(once, batch, order=[F.col("seq")]).collect())) == expected


def test_adaptive_windows_cover_everything_once(spark):
    days = [dt.datetime(1955, 3, 1)] * 3 + [dt.datetime(1961, 1, 1)] * 4
    days += [dt.datetime(1965, 5, 1)] * 4 + [dt.datetime(1965, 5, 2)] * 9
    days += [dt.datetime(1965, 7, 9)] * 2 + [dt.datetime(1940, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "StartDate timestamp_ntz")
    windows = window_summary(adaptive_windows(df, limit=5)).collect()
    found = sorted((r.level, str(r.window_start), str(r.window_end), r.n_rows) for r in windows)
    assert found == [
        ("chunk", "1940-01-01", "1949-12-31", 1),
        ("chunk", "1950-01-01", "1959-12-31", 3), ("day", "1965-05-01", "1965-05-01", 4),
        ("day", "1965-05-02", "1965-05-02", 9), ("month", "1965-07-01", "1965-07-31", 2),
        ("year", "1961-01-01", "1961-12-31", 4)]


def test_windows_end_with_the_last_year_and_keep_undated_rows(spark):
    days = [dt.datetime(1955, 3, 1), dt.datetime(1963, 1, 1), dt.datetime(1966, 5, 1), None, None]
    df = spark.createDataFrame(list(enumerate(days)), "id int, StartDate timestamp_ntz")
    windows = adaptive_windows(df, last_year=1964)
    found = sorted((r.level, str(r.window_start), str(r.window_end), r.n_rows)
                   for r in window_summary(windows).collect())
    assert found == [
        ("chunk", "1950-01-01", "1959-12-31", 1), ("chunk", "1960-01-01", "1964-12-31", 1),
        ("chunk", "1965-01-01", "1969-12-31", 1), ("undated", "None", "None", 2)]
    labelled = label_windows(df, windows)
    assert labelled.columns == ["id", "StartDate", "window_id"]
    assert [r.window_id for r in labelled.orderBy("id").collect()] == [
        "chunk:1950-01-01", "chunk:1960-01-01", "chunk:1965-01-01", "undated", "undated"]
    assert label_windows(df, windows.where("level = 'undated'")).where("window_id IS NULL").count() == 3


def test_station_exports_are_checked_file_by_file(spark, tmp_path):
    header, line = "Datum;Tid (UTC);Lufttemperatur;Kvalitet\n", "2020-01-01;06:00:00;{};G\n"
    (tmp_path / "good1.csv").write_text(line.format(9) + header + line.format(1))
    (tmp_path / "good2.csv").write_text(header + line.format(2) + header + line.format(3))
    found = read_station_export(spark, f"{tmp_path}/good*.csv", "temperature").collect()
    assert sorted(r.temperature for r in found) == [1.0, 2.0, 3.0]
    (tmp_path / "good3.csv").write_text(line.format(4))
    with pytest.raises(ValueError, match="good3"):
        read_station_export(spark, f"{tmp_path}/good*.csv", "temperature")


def test_reports_of_one_name_stay_apart(spark, tmp_path):
    for year in ("2020", "2021"):
        (tmp_path / year).mkdir()
        (tmp_path / year / "report.txt").write_text(f"Qheader {year}\n")
    out = str(tmp_path / "split")
    split_reports(spark, f"{tmp_path}/20*/report.txt", out)
    found = spark.read.text(out).select("report", "route", F.split("folder", "-")[0], "value")
    assert sorted(map(tuple, found.collect())) == [
        ("report", "meta_header", year, f"Qheader {year}") for year in ("2020", "2021")]


def test_lines_of_exports_are_sorted_without_their_paths(spark, tmp_path, monkeypatch):
    """Files of one name in different folders, with records over line ends, stay apart."""
    from skerry.sources import tables

    for folder, first in (("a" * 100, 1), ("b" * 100, 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.tsv").write_text("\n\nOccurrenceId\tLocality\n" + "".join(
            f'{first + i}\t"place\n{first + i}"\n' for i in range(4)))
    handed, join = [], tables.whole_records
    monkeypatch.setattr(tables, "whole_records", lambda lines: handed.append(lines) or join(lines))
    found = read_observation_export(spark, f"{tmp_path}/*/x.tsv").select("OccurrenceId", "Locality").collect()
    assert sorted(tuple(r) for r in found) == [(str(i), f"place\n{i}") for i in range(1, 9)]
    assert handed[0].schema["source_file"].dataType.simpleString() == "bigint"

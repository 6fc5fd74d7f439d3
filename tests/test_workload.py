"""Registered queries on rows built here."""

import datetime as dt
import hashlib
import time

import pytest

import __spark_entry__ as driver
from skerry.operators.cleaning import collate_reports
from skerry.sources.reports import parse_data_lines, split_reports
from workload.adapters import Tables
from workload.table_queries import _export_lines


@pytest.fixture
def stations(spark, tmp_path):
    """Both stations on two days; on the even one the backup knows what the other does not."""
    def event(day, kind):
        return dt.datetime(2024, 1, day, 5, 30), kind, 2.0

    events = [event(2, "view"), event(2, "error"), event(3, "view"), event(3, "view"), event(3, "error")]
    spark.createDataFrame(events, "ts timestamp_ntz, event_type string, value double").write.parquet(
        f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_split_by_backup_takes_all_days_of_the_backup_station(spark, stations):
    days = driver.queries()["weather_split_backup"](spark, stations).collect()
    assert [(r.date, r.total_precipitation, r.backup_gap_fill_used) for r in days] == [("2024-01-02", 2.0, True)]


def test_split_by_primary_leaves_out_all_days_of_the_backup_station(spark, stations):
    days = driver.queries()["weather_split_primary"](spark, stations).collect()
    assert [(r.date, r.total_precipitation, r.backup_gap_fill_used) for r in days] == [("2024-01-03", 4.0, False)]


def test_report_folders_cost_little_under_long_paths(spark, tmp_path):
    raw = tmp_path.joinpath(*[letter * 200 for letter in "abcdefghij"])
    raw.mkdir(parents=True)
    (raw / "y.2001.txt").write_text("C|1\n")
    (raw / "plain").write_text("R|2\n" * 4000)
    start = time.perf_counter()
    split_reports(spark, [f"{raw}/y.2001.txt", f"{raw}/plain"], f"{tmp_path}/out")
    assert time.perf_counter() - start < 6
    folder = "j" * 200 + "-" + hashlib.md5(f"file://{raw}".encode()).hexdigest()[:12]
    found = spark.read.text(f"{tmp_path}/out").groupBy("report", "route", "folder").count().collect()
    assert {tuple(r) for r in found} == {
        ("y.2001", "ring_records", folder, 1), ("plain", "ring_records", folder, 4000)}


def test_only_asked_fields_of_reports_are_taken(spark):
    lines = spark.createDataFrame([("f", 'C|7|"S|C"|NA')], "source_file string, value string")
    fields = parse_data_lines(lines)
    assert fields.select("record_type", "ring_number", "scheme", "station_code", "notes").first() == (
        "C", "7", "S|C", None, None)
    plan = fields.groupBy("record_type").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-1.#QNAN") <= 1 and "moult_score" not in plan


def test_export_files_keep_their_size(spark, tmp_path):
    """Rows further up the keys get files of their own."""
    day = dt.datetime(2024, 1, 1)
    for n in (1, 3):
        rows = [(i * 3 << 20 | k, 1, 1.0, day) for i in range(n) for k in range(96)]
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"
                              ).write.parquet(f"{tmp_path}/{n}/orders.parquet")
    few, many = (
        _export_lines(Tables(spark, f"{tmp_path}/{n}")).groupBy("provider", "piece").count().collect() for n in (1, 3))
    assert len(many) == 3 * len(few) and max(r["count"] for r in many) == max(r["count"] for r in few)
    assert driver.queries()["observation_export"](spark, f"{tmp_path}/3").count() == 3 * 96


def test_rows_are_dealt_out_before_copies_collapse(spark):
    line = "C|7|SCH|1|HERE||||{}|A" + "|" * 25
    lines = [("f", line.format(1)), ("f", line.format(1)), ("g", line.format(1)), ("g", line.format(2))]
    unique = collate_reports(
        parse_data_lines(spark.createDataFrame(lines, "source_file string, value string")), "SCH", "HERE")
    assert unique.count() == 2
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("REBALANCE_PARTITIONS_BY_COL")

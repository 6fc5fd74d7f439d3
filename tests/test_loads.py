"""Loads into stored tables: results, untouched files, failed and half-finished loads."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from skerry.schemas import OBSERVATIONS, WEATHER
from skerry.sinks import loads
from skerry.sinks.merge import replace_window, upsert


@pytest.fixture
def table(spark):
    name = "t" + uuid.uuid4().hex[:12]
    yield name
    for suffix in ("", "__keys", "__staged", "__touched", "__batch", "__keys__staged", "__keys__touched"):
        spark.sql(f"DROP TABLE IF EXISTS {name}{suffix}")


def files(spark, table, part):
    """Files of a partition with the time they were written."""
    found = spark.table(table).where(F.col(loads.PART) == part).select("_metadata.file_path", "_metadata.file_modification_time")
    return sorted(tuple(r) for r in found.distinct().collect())


def observed(spark, *rows):
    return spark.createDataFrame(
        [(k, day and dt.datetime.fromisoformat(day), v) for k, day, v in rows], "OccurrenceId string, StartDate timestamp_ntz, price double")


OLD = [("a", "2024-01-05", 1.0), ("b", "2024-01-09", 1.0), ("c", "2024-02-01", 1.0), ("d", "2024-03-01", 1.0), ("e", None, 1.0)]
NEW = [("b", "2024-02-20", 2.0), ("d", "2024-02-21", 1.5), ("d", "2024-02-21", 2.0), ("e", "2024-04-01", 2.0), ("n", "2024-04-02", 2.0), ("m", None, 2.0)]


def test_upsert_moves_rows_and_leaves_other_months_alone(spark, table):
    loads.create_stored(observed(spark, *OLD), table, "StartDate")
    january = files(spark, table, "2024-01")
    loads.upsert_stored(observed(spark, ("c", "2024-02-03", 5.0)), table, order=[F.col("price")])
    assert files(spark, table, "2024-01") == january
    expected = upsert(observed(spark, *OLD), observed(spark, ("c", "2024-02-03", 5.0)))
    expected = upsert(expected, observed(spark, *NEW), order=[F.col("price")])
    loads.upsert_stored(observed(spark, *NEW), table, order=[F.col("price")])
    once = sorted(map(tuple, loads.read_stored(spark, table).collect()), key=repr)
    assert once == sorted(map(tuple, expected.collect()), key=repr)
    assert sorted(loads.partitions(spark, table)) == ["2024-01", "2024-02", "2024-04", "undated"]  # March is gone
    loads.upsert_stored(observed(spark, *NEW), table, order=[F.col("price")])
    assert sorted(map(tuple, loads.read_stored(spark, table).collect()), key=repr) == once
    index = spark.table(f"{table}__keys").select("OccurrenceId", loads.PART)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, spark.table(table).select("OccurrenceId", loads.PART).collect()))


def test_upsert_of_nothing(spark, table):
    loads.create_stored(observed(spark, *OLD), table, "StartDate")
    loads.upsert_stored(observed(spark), table)
    assert spark.table(table).count() == len(OLD)


def hours(spark, *times):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t), v) for t, v in times], "observation_time timestamp_ntz, temperature double")


HOURS = [(f"2024-{m:02d}-{d:02d}T{h:02d}:00:00", 1.0) for m in range(1, 7) for d in (1, 15, 28) for h in (0, 12)]


@pytest.mark.parametrize("batch", [
    [("2024-02-15T12:00:00", 9.0), ("2024-05-01T00:00:00", 9.0)], [("2024-03-15T00:00:00", 9.0)], [("2024-08-01T00:00:00", 9.0)], []])
def test_replace_window_of_a_stored_table(spark, table, batch):
    loads.create_stored(hours(spark, *HOURS), table, "observation_time")
    before = {p: files(spark, table, p) for p in loads.partitions(spark, table)}
    loads.replace_window_stored(hours(spark, *batch), table)
    expected = replace_window(hours(spark, *HOURS), hours(spark, *batch))
    assert sorted(map(tuple, loads.read_stored(spark, table).collect())) == sorted(map(tuple, expected.collect()))
    months = sorted(t[:7] for t, _ in batch)
    for part, written in before.items():
        if not months or not months[0] <= part <= months[-1]:
            assert files(spark, table, part) == written


def test_a_failed_load_leaves_the_old_rows(spark, table):
    loads.create_stored(observed(spark, *OLD), table, "StartDate")
    bad = observed(spark, *NEW).withColumn("price", F.when(F.col("OccurrenceId") == "n", F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="lost"):
        loads.upsert_stored(bad, table)
    with pytest.raises(Exception, match="lost"):
        loads.replace_touched(spark.table(table).unionByName(bad.withColumn(loads.PART, loads.month_of(F.col("StartDate")))), table, ["2024-02"])
    assert sorted(map(tuple, loads.read_stored(spark, table).collect()), key=repr) == sorted(
        map(tuple, observed(spark, *OLD).collect()), key=repr)
    assert not loads.finish_load(spark, table)


def test_a_staged_load_is_finished_by_the_next(spark, table, monkeypatch):
    loads.create_stored(observed(spark, *OLD), table, "StartDate")
    finish = loads.finish_load
    monkeypatch.setattr(loads, "finish_load", lambda spark, name, part=loads.PART: False)  # the driver is lost at the commit
    loads.replace_touched(spark.table(table).where("OccurrenceId = 'zz'"), table, ["2024-01"])
    monkeypatch.setattr(loads, "finish_load", finish)
    assert spark.table(table).where(F.col(loads.PART) == "2024-01").count() == 2
    loads.upsert_stored(observed(spark, ("d", "2024-03-01", 3.0)), table)
    assert sorted(r.OccurrenceId for r in spark.table(table).collect()) == ["c", "d", "e"]


def test_schema_evolution_of_stored_tables(spark, table):
    assert loads.evolve_stored(spark, table, WEATHER, "observation_time", "observation_time") == ["created"]
    spark.sql(f"DROP TABLE {table}")
    loads.create_stored(hours(spark, *HOURS), table, "observation_time")
    january = files(spark, table, "2024-01")
    added = loads.evolve_stored(spark, table, WEATHER, "observation_time", "observation_time")
    assert len(added) == len(WEATHER) - 2 and files(spark, table, "2024-01") == january
    assert spark.table(table).where("temperature = 1 AND humidity IS NULL").count() == len(HOURS)
    assert loads.evolve_stored(spark, table, WEATHER, "observation_time", "observation_time") == []
    spark.sql(f"DROP TABLE {table}")
    hours(spark, *HOURS).withColumnRenamed("observation_time", "date").write.saveAsTable(table)
    assert loads.evolve_stored(spark, table, WEATHER, "observation_time", "observation_time") == ["rebuilt"]
    assert spark.table(table).isEmpty() and set(WEATHER.names) < set(spark.table(table).columns)


def test_loads_of_fetched_data(spark, table):
    loads.load_weather(hours(spark, *HOURS), table, station_id=7, station_name="s", data_source="d")
    loads.load_weather(hours(spark, (HOURS[3][0], 8.0)), table, station_id=7, station_name="s", data_source="d")
    stored = loads.read_stored(spark, table)
    assert set(stored.columns) == set(WEATHER.names) and stored.count() == len(HOURS)
    assert stored.where("temperature = 8 AND fetched_at IS NOT NULL AND station_id = 7").count() == 1
    spark.sql(f"DROP TABLE {table}")
    loads.load_observations(observed(spark, *OLD), table)
    loads.load_observations(observed(spark, *NEW), table)
    stored = loads.read_stored(spark, table)
    assert set(stored.columns) == set(OBSERVATIONS.names) and stored.count() == 7
    assert stored.where("OccurrenceId = 'b' AND month(StartDate) = 2 AND fetched_at IS NOT NULL").count() == 1

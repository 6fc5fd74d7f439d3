import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skerry.functions.dates import epoch_micros
from skerry.operators.asof import asof_join
from skerry.plans.weather import MATCHED, ringing_with_weather_in_force, weather_at_capture

T0 = dt.datetime(2024, 3, 1)
CAPTURES = (
    "record_id int, date date, time double, ring_number string, species_code string, "
    "swedish_name string, age string, weight double, wing_length int, fat_score int, "
    "muscle_score int"
)
WEATHER = "observation_time timestamp_ntz, " + ", ".join(f"{m} double" for m in MATCHED)


def capture(record_id, day, time):
    return (record_id, day, time, "r", "S", "s", "1K", 10.0, 60, 3, 1)


def reading(moment, value):
    return (moment, *[value] * len(MATCHED))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket", [3600, 86400])
def test_equals_brute_force(spark, seed, bucket):
    rng = random.Random(seed)
    span = 40 * 86400

    def moment():
        return T0 + dt.timedelta(seconds=rng.randrange(span), microseconds=rng.randrange(10**6))

    right = [(moment(), i) for i in range(60)] + [(T0 + dt.timedelta(hours=5), 999)]
    # A hot timestamp, one that equals a reading, and ones outside the readings on both sides.
    left = [(i, moment()) for i in range(200)] + [(1000 + i, right[0][0]) for i in range(200)]
    left += [(2000, T0 - dt.timedelta(days=3)), (2001, T0 + dt.timedelta(days=400)), (2002, None)]
    joined = asof_join(
        spark.createDataFrame(left, "id int, at timestamp_ntz"),
        spark.createDataFrame(right, "seen timestamp_ntz, value int"),
        "at", "seen", bucket_seconds=bucket, gap="gap")
    expected = {}
    for key, at in left:
        earlier = [r for r in right if at is not None and r[0] <= at]
        if earlier:
            expected[key] = max(earlier)
    found = {r.id: (r.seen, r.value) for r in joined.collect()}
    assert found == expected
    assert joined.where("gap < 0").isEmpty()


def test_left_join_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, T0), (2, None)], "id int, at timestamp_ntz")
    right = spark.createDataFrame([(T0 + dt.timedelta(1), 5)], "seen timestamp_ntz, value int")
    joined = asof_join(left, right, "at", "seen", how="left")
    assert sorted(joined.select("id", "value").collect()) == [(1, None), (2, None)]


def test_duplicate_readings_match_once(spark):
    left = spark.createDataFrame([(1, T0)], "id int, at timestamp_ntz")
    right = spark.createDataFrame([(T0, 5), (T0, 7), (T0, 7)], "seen timestamp_ntz, value int")
    assert [r.value for r in asof_join(left, right, "at", "seen").collect()] == [7]


def test_stale_readings_are_blanked_and_early_captures_dropped(spark):
    day = T0.date()
    captures = spark.createDataFrame(
        [capture(1, day, 4.0), capture(2, day, 6.0), capture(3, day, 6.5), capture(4, day, 3.0),
         capture(5, day, None), capture(6, day, 4.999)], CAPTURES)
    weather = spark.createDataFrame([reading(T0.replace(hour=4), 1.5)], WEATHER)
    found = {
        r.record_id: (r.weather_match_hours, r.temperature)
        for r in weather_at_capture(captures, weather, ordered=True).collect()
    }
    # Exactly two hours is still fresh; before the first reading and without a time: no row.
    assert found == {1: (0.0, 1.5), 2: (2.0, 1.5), 3: (2.5, None), 6: (0.98, 1.5)}


def test_groups_are_per_whole_hour(spark):
    day = T0.date()
    captures = spark.createDataFrame(
        [capture(1, day, 5.2), capture(2, day, 5.9), capture(3, day, 6.0)], CAPTURES)
    weather = spark.createDataFrame([reading(T0.replace(hour=4), 1.5)], WEATHER)
    result = ringing_with_weather_in_force(captures, weather)
    assert [(r.capture_hour, r.captures, r.weather_match_hours) for r in result.collect()] == [
        (5, 2, 1.0), (6, 1, 2.0)]


def ancestors(plan: str, marker: str) -> list[str]:
    """Operators from the scan that mentions ``marker`` up to the root."""
    def depth(line):
        return next(i for i, c in enumerate(line) if c.isalpha() or c == "(" or c == "*")

    lines = [line for line in plan.splitlines() if any(c.isalpha() for c in line)]
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and marker in line)
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            found.append(line[level:])
    return found


def test_plan_shuffles_the_left_side_at_most_once(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    readings = events.where("event_type = 'view'").select(F.col("ts").alias("seen"), "value")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        joined = asof_join(events.select("event_id", "ts"), readings, "ts", "seen")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, usual)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    above = [line.split(" ")[0].split("(")[0] for line in ancestors(plan, "event_id")]
    assert above.count("Exchange") == 1 and "Window" not in above
    assert not [name for name in above if "Aggregate" in name]


def test_a_hot_bucket_is_split_between_tasks(spark):
    """A third of the left rows share one minute; the final plan cuts their partition up."""
    minute = F.when(F.col("id") % 3 == 0, 77).otherwise((F.col("id") * 7919) % 60000)
    left = spark.range(0, 300_000, 1, 8).select(
        "id", (F.lit(T0) + F.make_dt_interval(mins=minute.cast("int"))).alias("at"))
    right = spark.range(0, 1000, 1, 2).select(
        (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("seen"),
        F.col("id").alias("value"))
    left = left.withColumn("at", F.col("at").cast("timestamp_ntz"))
    right = right.withColumn("seen", F.col("seen").cast("timestamp_ntz"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    usual = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = asof_join(left, right, "at", "seen")
        matched = joined.groupBy().count().withColumnRenamed("count", "n")
        off = F.col("value") != F.floor(
            (epoch_micros(F.col("at")) - epoch_micros(F.lit(T0).cast("timestamp_ntz"))) / 3.6e9)
        assert joined.where(off).isEmpty()
        rows = matched.collect()
        plan = matched._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in usual.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert rows[0].n == 300_000
    assert "skew=true" in plan.replace("isSkew", "skew")


def test_long_times_between_readings_cost_nothing(spark):
    """A reading in year 1 and one in year 9999: intervals are made for the buckets of left rows."""
    right = spark.createDataFrame(
        [(dt.datetime(1, 1, 1), 1), (T0, 2), (dt.datetime(9999, 1, 1), 3)], "seen timestamp_ntz, value int")
    left = spark.createDataFrame(
        [(1, T0 - dt.timedelta(1)), (2, T0 + dt.timedelta(9000)), (3, dt.datetime(9999, 6, 1)), (4, dt.datetime(1, 1, 1))],
        "id int, at timestamp_ntz")
    for bucket in (60, 3600):
        found = asof_join(left, right, "at", "seen", bucket_seconds=bucket).select("id", "value").collect()
        assert sorted(map(tuple, found)) == [(1, 1), (2, 2), (3, 3), (4, 1)]

"""Hand-made rows for semantics that the test tables do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skerry.functions import bins
from skerry.functions.dates import calendar_season, period_start
from skerry.operators.filters import between_dates, of_species, select_captures
from skerry.operators.joins import latest_by_time, patch_from_backup, species_lookup
from skerry.plans import body, captures, correlation, heatmap, overview, phenology, weather

D = dt.date
COLUMNS = (
    "date date, ring_number string, species_code string, swedish_name string, age string, "
    "ringer string, weight double, wing_length int, fat_score int"
)


def caught(day, ring="r", species="A", weight=10.0, fat=3, age="1K", ringer="me", name=None):
    return (day, ring, species, name or species.lower(), age, ringer, weight, 60, fat)


@pytest.fixture
def df(spark):
    return lambda *rows: spark.createDataFrame(list(rows), COLUMNS)


def test_iso_week_53_keeps_the_calendar_year(df):
    row = phenology.phenology_weekly(df(caught(D(2021, 1, 3))), aggregate_years=False).first()
    assert (row.year, row.week_of_year) == (2021, 53)


def test_change_is_against_the_previous_year_with_data(df):
    records = [caught(D(2018, 5, 1))] * 2 + [caught(D(2021, 5, 1))] * 3
    rows = captures.year_over_year(df(*records)).collect()
    assert [(r.year, r.prev_year_count, r.absolute_change, r.percent_change) for r in rows] == [
        (2018, None, None, None), (2021, 2, 1, 50.0)]


def test_rings_without_number(df):
    records = [caught(D(2020, 1, i), ring) for ring in (None, "", "x") for i in (1, 9)]
    strict = captures.recapture_analysis(df(*records)).collect()
    assert [(r.ring_number, r.days_between, r.years_between) for r in strict] == [("x", 8, 0.02)]
    assert captures.recapture_stats(df(*records)).count() == 3


def test_null_counts_as_one_distinct_value(df):
    records = df(caught(D(2020, 1, 1), None), caught(D(2020, 1, 1), "x"))
    row = overview.selection_summary(records, "2020-01-01", "2020-12-31").first()
    assert row.unique_individuals == 2
    assert captures.species_time_series(records).first().unique_individuals == 1


def test_single_row_has_no_spread(df):
    row = phenology.phenology_daily(df(caught(D(2020, 2, 1)))).first()
    assert row.std_count is None and row.avg_count == 1.0
    assert body.body_metrics(df(caught(D(2020, 2, 1)))).first().std_weight is None


def test_unusable_measurements(df):
    records = df(*[caught(D(2020, 1, 1), weight=w, fat=f)
                   for w, f in ((0.0, 11), (None, None), (5.0, 10), (7.0, 0))])
    assert body.yearly_weight(records).first().n == 2
    assert body.fat_score(records).first()["count"] == 2


def test_filters_parse_dates_at_the_boundary(df):
    records = df(caught(D(2020, 1, 1)), caught(D(2020, 1, 2), species="B"))
    assert between_dates(records, "2020-01-02").count() == 1
    with pytest.raises(ValueError):
        between_dates(records, "2020-13-01")
    assert of_species(records, []).count() == 0 and of_species(records, "B").count() == 1
    assert select_captures(records, species_codes=[]).count() == 2
    hostile = of_species(records, ["A' OR '1'='1"])
    assert hostile.count() == 0


def test_unknown_aggregation_is_daily(df):
    records = df(caught(D(2020, 1, 1)))
    day = records.select(period_start(F.col("date"), "hourly").alias("p")).first().p
    assert day == D(2020, 1, 1)


def test_heatmap_shares_add_up_and_ties_go_to_the_smaller_code(df):
    records = df(*[caught(D(2020, m, 1), species=s) for s in "ABC" for m in (1, 5, 9)])
    rows = heatmap.weekly_heatmap(records, 2020, 2).collect()
    assert {r.species_code for r in rows} == {"A", "B"}
    for code in "AB":
        shares = [r.percent_of_total for r in rows if r.species_code == code]
        assert sum(shares) == pytest.approx(100, abs=0.05)
    matrix = heatmap.heatmap_matrix(heatmap.weekly_heatmap(records, 2020, 2))
    assert matrix.columns == ["swedish_name", *[str(w) for w in range(1, 53)]]


def test_heatmap_matrix_adds_week_53_only_with_data(df):
    records = df(caught(D(2021, 1, 2)), caught(D(2021, 6, 2)))
    assert "53" in heatmap.heatmap_matrix(heatmap.weekly_heatmap(records)).columns


def test_pivot_leaves_absent_pairs_null(df):
    wide = captures.pivot_by_time(df(caught(D(2020, 1, 1)), caught(D(2020, 1, 2), species="B")))
    assert [(r.A, r.B) for r in wide.collect()] == [(1, None), (None, 1)]


def test_bins_are_closed_on_the_right(spark):
    values = spark.createDataFrame([(v,) for v in (0.0, 3.0, 3.1, 50.0, 50.1, None)], "v double")
    labels = [r.b for r in values.select(bins.cut(F.col("v"), *bins.WIND).alias("b")).collect()]
    assert labels == [None, "Calm (0–3)", "Light (3–6)", "Strong (>10)", None, None]
    with pytest.raises(ValueError):
        bins.cut(F.col("v"), (0, 1), ("a", "b"))


def test_seasons(spark):
    months = spark.range(1, 13).select(calendar_season(F.col("id")).alias("s"))
    assert [r.s for r in months.collect()] == (
        ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"])


def hours(spark, *values):
    """Readings of one day: (hour, temperature, precipitation)."""
    base = dt.datetime(2024, 5, 1)
    names = [m for m in weather.MATCHED if m not in ("temperature", "precipitation")]
    frame = spark.createDataFrame(
        [(base + dt.timedelta(hours=h), t, p) for h, t, p in values],
        "observation_time timestamp_ntz, temperature double, precipitation double")
    return frame.withColumns({m: F.lit(None).cast("double") for m in names}).withColumn(
        "precipitation_quality", F.lit("G"))


def test_completeness_and_hour_window(spark, df):
    station = hours(spark, *[(h, float(h), 1.0) for h in range(24)])
    row = weather.ringing_window_weather(station, station).first()
    assert (row.data_completeness, row.min_temperature, row.max_temperature) == (1.1, 3.0, 13.0)
    assert weather.daily_weather_summary(station, station).first().data_completeness == 1.0


def test_backup_fills_only_what_is_missing(spark):
    station = hours(spark, (1, 1.0, None), (2, 2.0, 4.0), (3, 3.0, None))
    backup = hours(spark, (1, 9.0, 5.0), (2, 9.0, 6.0)).withColumn(
        "precipitation_quality", F.lit("Y"))
    patched = patch_from_backup(station, backup).orderBy("observation_time").collect()
    assert [(r.precipitation, r.precipitation_quality, r.temperature) for r in patched] == [
        (5.0, "Y", 1.0), (4.0, "G", 2.0), (None, "G", 3.0)]
    day = weather.daily_weather_summary(station, backup).first()
    assert day.total_precipitation == 9.0 and day.backup_gap_fill_used is True
    after = weather.daily_weather_summary(patch_from_backup(station, backup), backup).first()
    assert after.backup_gap_fill_used is False


def test_latest_source_wins(spark):
    kind = "observation_time timestamp_ntz, value double"
    t = dt.datetime(2024, 1, 1)
    archive = spark.createDataFrame([(t, 9.0), (t + dt.timedelta(1), 2.0)], kind)
    latest = spark.createDataFrame([(t, 1.0)], kind)
    assert sorted(r.value for r in latest_by_time(archive, latest).collect()) == [1.0, 2.0]


def test_weeks_without_rain_values_count_as_dry(spark):
    daily = spark.createDataFrame(
        [(D(2024, 1, 1), 3)], "date date, captures int").withColumns({
            **{c: F.lit(None).cast("double") for c in correlation.DAILY_WEATHER},
            "month": F.lit(1)})
    row = correlation.weekly_all(daily).first()
    assert (row.total_precipitation, row.mean_temperature, row.season) == (0.0, None, "Winter")


def test_trend_needs_enough_points_and_skips_nulls_pairwise(spark):
    data = [(float(i), 2.0 * i + 1, None if i < 3 else 1.0 * i) for i in range(8)]
    frame = spark.createDataFrame(data, "x double, y double, z double")
    rows = correlation.ols_trend(frame, "y", ["x", "z"], 5).collect()
    assert [(r.variable, r.n, r.slope, r.intercept) for r in rows] == [("x", 8, 2.0, 1.0)]


def test_species_lookup_does_not_multiply_rows(spark):
    names = spark.createDataFrame(
        [("abc", "Sci", "Swe", "1"), ("ABC", "Sci", "Swe", "1")],
        "`Sökträff` string, `Vetenskapligt namn` string, `Svenskt namn` string, TaxonID string")
    birds = spark.createDataFrame([("ABC",), ("XYZ",)], "species_code string")
    assert sorted((r.species_code, r.swedish_name) for r in species_lookup(birds, names).collect()
                  ) == [("ABC", "Swe"), ("XYZ", None)]


def test_empty_input(df, spark):
    empty = df()
    for result in (captures.species_time_series(empty), phenology.migration_windows(empty),
                   heatmap.weekly_heatmap(empty), body.body_metrics(empty)):
        assert result.isEmpty()

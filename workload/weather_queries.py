"""Queries over weather, and over captures and weather together."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import bins
from skerry.operators.filters import in_hours, null_if_stale, since
from skerry.operators.joins import (
    fillable_counts, latest_by_time, null_audit, patch_from_backup, widen, with_backup,
)
from skerry.plans import captures, correlation, weather
from skerry.schemas import WEATHER_MEASURES
from skerry.sinks.merge import replace_window
from workload.capture_queries import BOX_COLUMNS, box_sql
from workload.registry import register

MEASURES = list(weather.MATCHED)
_MEASURES = " ".join(f"{m}:f" for m in MEASURES)
_BOTH = "weather_a weather_b"

# ---------------------------------------------------------------- weather alone

register("weather_hourly",
         f"observation_time:t date:d hour:i {_MEASURES} " + " ".join(
             f"{q}:s" for q in weather.QUALITY),
         lambda t: weather.weather_hourly(t.weather_a, "2024-01-03", "2024-01-25"),
         "weather_a", """
        SELECT *, CAST(observation_time AS DATE) AS date, extract(hour FROM observation_time) AS hour
        FROM weather_a WHERE observation_time >= TIMESTAMP '2024-01-03'
          AND observation_time < TIMESTAMP '2024-01-26'""")

_MEANS = """
               avg(temperature) AS mean_temperature, min(temperature) AS min_temperature,
               max(temperature) AS max_temperature, avg(wind_speed) AS mean_wind_speed,
               max(gust_wind) AS max_gust, avg(wind_direction) AS mean_wind_direction,
               avg(humidity) AS mean_humidity, sum(precipitation) AS total_precipitation,
               avg(pressure) AS mean_pressure, avg(visibility) AS mean_visibility,
               avg(cloud_cover) AS mean_cloud_cover"""
_SUMMARY = ("mean_temperature:f min_temperature:f max_temperature:f mean_wind_speed:f max_gust:f "
            "mean_wind_direction:f mean_humidity:f total_precipitation:f mean_pressure:f "
            "mean_visibility:f mean_cloud_cover:f")
for unit, part in (("daily", "day"), ("weekly", "week"), ("monthly", "month")):
    register(f"weather_{unit}", f"period:d {_SUMMARY} n_obs:i",
             lambda t, unit=unit: weather.weather_by_period(t.weather_a_year, aggregation=unit),
             "weather_a_year", f"""
        SELECT date_trunc('{part}', observation_time) AS period, {_MEANS}, count(*) AS n_obs
        FROM weather_a_year GROUP BY 1""")

_SPARE = ("precipitation", "pressure", "visibility")
_FILLED_SQL = """
        SELECT a.* REPLACE (ifnull(a.precipitation, b.precipitation) AS precipitation,
                            ifnull(a.pressure, b.pressure) AS pressure,
                            ifnull(a.visibility, b.visibility) AS visibility),
               (a.precipitation IS NULL AND b.precipitation IS NOT NULL)
               OR (a.pressure IS NULL AND b.pressure IS NOT NULL)
               OR (a.visibility IS NULL AND b.visibility IS NOT NULL) AS used,
               CAST(a.observation_time AS DATE) AS date
        FROM weather_a AS a LEFT JOIN weather_b AS b USING (observation_time)"""
_DAILY_SQL = f"""
        SELECT date, year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year,
               {_MEANS}, count(temperature) / CAST(24 AS DOUBLE) AS data_completeness,
               max(used) AS backup_gap_fill_used
        FROM ({_FILLED_SQL}) GROUP BY date"""
_DAILY = f"date:d year:i month:i day_of_year:i {_SUMMARY} data_completeness:f backup_gap_fill_used:b"


def _daily(t, *dates):
    return weather.daily_weather_summary(t.weather_a, t.weather_b, *dates)


register("daily_weather_summary", _DAILY, _daily, _BOTH, _DAILY_SQL)

for source, flag in (("backup", True), ("primary", False)):
    register(f"weather_split_{source}", _DAILY,
             lambda t, flag=flag: weather.weather_split(_daily(t), flag), _BOTH,
             f"SELECT * FROM ({_DAILY_SQL}) WHERE backup_gap_fill_used = {flag}")
register("hour_window", "hour:i n:i",
         lambda t: in_hours(t.weather_a).groupBy(F.hour("observation_time").alias("hour")).agg(
             F.count(F.lit(1)).alias("n")), "weather_a", """
        SELECT extract(hour FROM observation_time) AS hour, count(*) AS n FROM weather_a
        GROUP BY 1 HAVING hour BETWEEN 3 AND 13""")
register("since_cutoff", f"observation_time:t {_MEASURES}",
         lambda t: since(t.weather_a, "2024-01-15"), "weather_a",
         "SELECT * FROM weather_a WHERE observation_time >= TIMESTAMP '2024-01-15'")
register("backup_join", "observation_time:t backup_precipitation:f backup_pressure:f "
         "backup_visibility:f precipitation:f",
         lambda t: with_backup(t.weather_a, t.weather_b), _BOTH, """
        SELECT observation_time, b.precipitation AS backup_precipitation,
               b.pressure AS backup_pressure, b.visibility AS backup_visibility,
               weather_a.precipitation AS precipitation
        FROM weather_a LEFT JOIN weather_b AS b USING (observation_time)""")
register("patch_from_backup",
         "observation_time:t precipitation:f pressure:f visibility:f precipitation_quality:s "
         "pressure_quality:s visibility_quality:s",
         lambda t: patch_from_backup(t.weather_a, t.weather_b), _BOTH, "SELECT observation_time, "
         + ", ".join(
             f"CASE WHEN a.{c} IS NULL THEN b.{c} ELSE a.{c} END AS {c}, "
             f"CASE WHEN a.{c} IS NULL AND b.{c} IS NOT NULL THEN b.{c}_quality "
             f"ELSE a.{c}_quality END AS {c}_quality" for c in _SPARE)
         + " FROM weather_a AS a LEFT JOIN weather_b AS b USING (observation_time)")
register("fillable_counts",
         "precipitation_fillable:i pressure_fillable:i visibility_fillable:i",
         lambda t: fillable_counts(t.weather_a, t.weather_b), _BOTH, "SELECT " + ", ".join(
             f"sum(if(a.{c} IS NULL AND b.{c} IS NOT NULL, 1, 0)) AS {c}_fillable"
             for c in _SPARE) + " FROM weather_a AS a, weather_b AS b "
         "WHERE a.observation_time = b.observation_time")
register("null_audit",
         "precipitation_null:i pressure_null:i visibility_null:i min_date:d max_date:d",
         lambda t: null_audit(t.weather_a), "weather_a", "SELECT " + ", ".join(
             f"count(*) - count({c}) AS {c}_null" for c in _SPARE)
         + ", min(observation_time) AS min_date, max(observation_time) AS max_date FROM weather_a")

# Archive and latest readings of each parameter; the latest win.
_PICKED_SQL = """
        SELECT observation_time, parameter, value FROM weather_long
        QUALIFY row_number() OVER (PARTITION BY observation_time, parameter
                                   ORDER BY priority DESC) = 1"""


def _one_parameter(t, name: str):
    long = t.weather_long.where(F.col("parameter") == name)
    parts = [
        long.where(F.col("priority") == priority).select("observation_time", "value")
        for priority in (1, 2)
    ]
    return latest_by_time(*parts).select(
        "observation_time", F.lit(name).alias("parameter"), "value")


register("latest_wins", "observation_time:t parameter:s value:f",
         lambda t: since(reduce(DataFrame.unionByName, [_one_parameter(t, m) for m in WEATHER_MEASURES]), "2024-01-02"),
         "weather_long", f"SELECT * FROM ({_PICKED_SQL}) WHERE observation_time >= TIMESTAMP '2024-01-02'")
register("wide_from_long", f"observation_time:t {_MEASURES}",
         lambda t: widen(
             t.weather_long.groupBy("observation_time", "parameter").agg(
                 F.max_by("value", "priority").alias("value")), WEATHER_MEASURES),
         "weather_long", "SELECT observation_time, " + ", ".join(
             f"any_value(value) FILTER (WHERE parameter = '{m}') AS {m}" for m in MEASURES)
         + f" FROM ({_PICKED_SQL}) GROUP BY observation_time")
register("replace_window", f"observation_time:t {_MEASURES}",
         lambda t: replace_window(
             t.weather_a.select("observation_time", *MEASURES),
             t.weather_b.select("observation_time", *MEASURES).where(
                 F.dayofmonth("observation_time").between(10, 20)
                 & (F.hour("observation_time") % 2 == 0))), _BOTH, f"""
        WITH batch AS (SELECT observation_time, {', '.join(MEASURES)} FROM weather_b
                       WHERE day(observation_time) BETWEEN 10 AND 20
                         AND extract(hour FROM observation_time) % 2 = 0)
        SELECT observation_time, {', '.join(MEASURES)} FROM weather_a
        WHERE observation_time < (SELECT min(observation_time) FROM batch)
           OR observation_time > (SELECT max(observation_time) FROM batch)
        UNION ALL SELECT * FROM batch""")

# ---------------------------------------------------------------- captures with weather

_RINGING_DAILY_SQL = f"""
        WITH r AS (SELECT date, species_code, swedish_name, count(*) AS captures,
                          avg(weight) AS mean_weight, avg(fat_score) AS mean_fat_score
                   FROM captures_ev GROUP BY ALL),
        w AS (SELECT date, {_MEANS}, count(temperature) / CAST(10 AS DOUBLE) AS data_completeness
              FROM ({_FILLED_SQL}) WHERE extract(hour FROM observation_time) BETWEEN 3 AND 13
              GROUP BY date)
        SELECT * FROM r LEFT JOIN w USING (date)"""
_RINGING = "date:d species_code:s swedish_name:s captures:i mean_weight:f mean_fat_score:f"
_ALL = f"captures_ev {_BOTH}"


def _ringing_daily(t):
    return weather.ringing_with_daily_weather(t.captures_ev, t.weather_a, t.weather_b)


register("ringing_weather_daily", f"{_RINGING} {_SUMMARY} data_completeness:f", _ringing_daily,
         _ALL, _RINGING_DAILY_SQL)

_FRESH = ", ".join(f"CASE WHEN gap <= 2 THEN {m} END AS {m}" for m in MEASURES)
register("ringing_weather_nearest",
         f"date:d capture_hour:i species_code:s swedish_name:s captures:i mean_weight:f "
         f"mean_fat_score:f weather_ts:t weather_match_hours:f {_MEASURES}",
         lambda t: weather.ringing_with_weather_in_force(t.captures_ev, t.weather_a),
         "captures_ev weather_a", f"""
        WITH g AS (SELECT date, CAST(floor(time) AS INTEGER) AS capture_hour, species_code,
                          swedish_name, count(*) AS captures, avg(weight) AS mean_weight,
                          avg(fat_score) AS mean_fat_score
                   FROM captures_ev GROUP BY ALL),
        s AS (SELECT *, date + to_hours(capture_hour) AS moment FROM g),
        m AS (SELECT s.*, w.* EXCLUDE (observation_time), observation_time AS weather_ts,
                     round((epoch(moment) - epoch(observation_time)) / 3600, 1) AS gap
              FROM s ASOF JOIN weather_a AS w ON s.moment >= w.observation_time)
        SELECT date, capture_hour, species_code, swedish_name, captures, mean_weight,
               mean_fat_score, weather_ts, gap AS weather_match_hours, {_FRESH} FROM m""")

_AT_CAPTURE_SQL = f"""
        WITH s AS (SELECT *, date + to_minutes(CAST(floor(time) AS INTEGER) * 60
                       + CAST(floor((time - floor(time)) * 60) AS INTEGER)) AS moment
                   FROM captures_ev),
        m AS (SELECT s.*, w.* EXCLUDE (observation_time), observation_time AS weather_ts,
                     round((epoch(moment) - epoch(observation_time)) / 3600, 2) AS gap
              FROM s ASOF JOIN weather_a AS w ON s.moment >= w.observation_time)
        SELECT record_id, date, time, ring_number, species_code, swedish_name, age, weight,
               wing_length, fat_score, muscle_score, weather_ts, gap AS weather_match_hours,
               {_FRESH} FROM m"""
_CAPTURE = ("record_id:i date:d time:f ring_number:s species_code:s swedish_name:s age:s weight:f "
            "wing_length:i fat_score:i muscle_score:i weather_ts:t weather_match_hours:f")


def _at_capture(t):
    return weather.weather_at_capture(t.captures_ev, t.weather_a)


register("weather_at_capture", f"{_CAPTURE} {_MEASURES}", _at_capture, "captures_ev weather_a",
         _AT_CAPTURE_SQL)
register("null_if_stale", "record_id:i weather_match_hours:f temperature:f gust_wind:f",
         lambda t: null_if_stale(
             weather.weather_at_capture(t.captures_ev, t.weather_a, max_gap_hours=1000), 0.5),
         "captures_ev weather_a", f"""
        SELECT record_id, weather_match_hours,
               if(weather_match_hours <= 0.5, temperature, NULL) AS temperature,
               if(weather_match_hours <= 0.5, gust_wind, NULL) AS gust_wind
        FROM ({_AT_CAPTURE_SQL})""")

# ---------------------------------------------------------------- correlation

_SEASON_SQL = """CASE WHEN month IN (3, 4, 5) THEN 'Spring' WHEN month IN (6, 7) THEN 'Summer'
                      WHEN month IN (8, 9, 10, 11) THEN 'Autumn' ELSE 'Winter' END AS season"""
_DAILY_ALL_SQL = f"""
        SELECT *, {_SEASON_SQL} FROM (
            SELECT date, month(date) AS month, year(date) AS year, sum(captures) AS captures,
                   {', '.join(f'any_value({c}) AS {c}' for c in correlation.DAILY_WEATHER)}
            FROM ({_RINGING_DAILY_SQL}) GROUP BY date)"""
_DAILY_ALL = "date:d captures:i {} month:i season:s year:i".format(
    " ".join(f"{c}:f" for c in correlation.DAILY_WEATHER))


def _daily_all(t):
    return correlation.daily_all(_ringing_daily(t))


register("daily_all", _DAILY_ALL, _daily_all, _ALL, _DAILY_ALL_SQL)
_WEEK_MEANS = ("mean_temperature", "mean_wind_speed", "mean_visibility", "mean_humidity",
               "mean_pressure", "mean_cloud_cover")
_WEEKLY_SQL = f"""
        SELECT *, {_SEASON_SQL} FROM (
            SELECT date_trunc('week', date) AS week_start, sum(captures) AS captures,
                   {', '.join(f'avg({c}) AS {c}' for c in _WEEK_MEANS)},
                   max(max_gust) AS max_gust,
                   coalesce(sum(total_precipitation), 0) AS total_precipitation,
                   (list(month ORDER BY date))[1] AS month
            FROM ({_DAILY_ALL_SQL}) GROUP BY 1)"""
register("weekly_all",
         "week_start:d captures:i " + " ".join(f"{c}:f" for c in _WEEK_MEANS)
         + " max_gust:f total_precipitation:f month:i season:s",
         lambda t: correlation.weekly_all(_daily_all(t)), _ALL, _WEEKLY_SQL)


def _trend_sql(source: str, y: str, variables, least: int, by: str = "") -> str:
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {group}'{x}' AS variable, regr_count({y}, {x}) AS n, "
        f"regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept "
        f"FROM ({source}){tail} HAVING regr_count({y}, {x}) > {least}" for x in variables)


_FIT = "variable:s n:i slope:f intercept:f"
register("trend_daily", _FIT,
         lambda t: correlation.ols_trend(_daily_all(t), min_points=10), _ALL,
         _trend_sql(_DAILY_ALL_SQL, "captures", correlation.TREND_VARIABLES, 10))
register("trend_weekly", _FIT,
         lambda t: correlation.ols_trend(
             correlation.weekly_all(_daily_all(t)), min_points=3), _ALL,
         _trend_sql(_WEEKLY_SQL, "captures", correlation.TREND_VARIABLES, 3))


def _over_the_year(t):
    return SimpleNamespace(captures_ev=t.captures_ev_year, weather_a=t.weather_a_year, weather_b=t.weather_b_year)


_YEAR_SQL = reduce(lambda sql, view: sql.replace(view, f"{view}_year"), _ALL.split(), _DAILY_ALL_SQL)
register("trend_by_season", f"season:s {_FIT}",
         lambda t: correlation.ols_trend(
             _daily_all(_over_the_year(t)), variables=["mean_visibility", "mean_temperature"], by=["season"]),
         " ".join(f"{view}_year" for view in _ALL.split()),
         _trend_sql(_YEAR_SQL, "captures", ["mean_visibility", "mean_temperature"], 5, "season"))


def _cut_sql(value: str, edges, labels) -> str:
    cases = " ".join(
        f"WHEN {value} > {low} AND {value} <= {high} THEN '{label}'"
        for low, high, label in zip(edges, edges[1:], labels))
    return f"CASE {cases} END"


_BINS_SQL = f"""
        SELECT *, {_cut_sql('mean_wind_speed', *bins.WIND)} AS wind_cat,
               {_cut_sql('mean_temperature', *bins.TEMPERATURE)} AS temp_cat,
               {_cut_sql('mean_cloud_cover', *bins.CLOUD)} AS cloud_cat,
               {_cut_sql('coalesce(total_precipitation, 0)', *bins.RAIN)} AS precip_cat
        FROM ({_DAILY_ALL_SQL}) WHERE captures > 0"""
register("weather_bins", "date:d captures:i wind_cat:s temp_cat:s cloud_cat:s precip_cat:s",
         lambda t: correlation.weather_bins(_daily_all(t)), _ALL, _BINS_SQL)
register("captures_by_bin", f"category:s bin:s {BOX_COLUMNS}",
         lambda t: correlation.captures_by_bin(correlation.weather_bins(_daily_all(t))), _ALL,
         box_sql(" UNION ALL ".join(
             f"SELECT '{c}' AS category, {c} AS bin, captures FROM ({_BINS_SQL}) "
             f"WHERE {c} IS NOT NULL"
             for c in ("wind_cat", "temp_cat", "cloud_cat", "precip_cat")),
             "captures", "category, bin"))
register("hourly_bins", "wind_cat:s temp_cat:s cloud_cat:s n:i",
         lambda t: t.weather_a.groupBy(
             bins.cut(F.col("wind_speed"), *bins.WIND).alias("wind_cat"),
             bins.cut(F.col("temperature"), *bins.TEMPERATURE).alias("temp_cat"),
             bins.cut(F.col("cloud_cover"), *bins.CLOUD).alias("cloud_cat"),
         ).agg(F.count(F.lit(1)).alias("n")), "weather_a", f"""
        SELECT {_cut_sql('wind_speed', *bins.WIND)} AS wind_cat,
               {_cut_sql('temperature', *bins.TEMPERATURE)} AS temp_cat,
               {_cut_sql('cloud_cover', *bins.CLOUD)} AS cloud_cat, count(*) AS n
        FROM weather_a GROUP BY ALL""")
register("correlation_matrix", "var_a:s var_b:s r:f",
         lambda t: correlation.correlation_matrix(_daily_all(t)), _ALL, " UNION ALL ".join(
             f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r "
             f"FROM ({_DAILY_ALL_SQL})"
             for a in correlation.CORRELATED for b in correlation.CORRELATED))

_MATCHED_SQL = f"""
        WITH f AS (SELECT * FROM ({_AT_CAPTURE_SQL}) WHERE weather_match_hours <= 2)
        SELECT * FROM f WHERE swedish_name IN (
            SELECT swedish_name FROM f GROUP BY ALL ORDER BY count(*) DESC, swedish_name LIMIT 2)"""
_VALID = {"fat_score": "fat_score BETWEEN 0 AND 10", "weight": "weight > 0"}
_POINTS_SQL = "SELECT *, month(date) AS month FROM (" + " UNION ALL ".join(
    f"SELECT record_id, swedish_name, date, '{x}' AS variable, {x} AS x, '{y}' AS metric, "
    f"CAST({y} AS DOUBLE) AS y FROM ({_MATCHED_SQL}) WHERE {x} IS NOT NULL AND {valid}"
    for x in ("temperature", "wind_speed") for y, valid in _VALID.items()) + ")"


def _matched(t):
    return correlation.matched_captures(_at_capture(t), 2)


register("capture_weather_points",
         "record_id:i swedish_name:s date:d variable:s x:f metric:s y:f season:s",
         lambda t: correlation.capture_weather_points(_matched(t)), "captures_ev weather_a",
         f"SELECT *, {_SEASON_SQL} FROM ({_POINTS_SQL})")
register("points_trend", "variable:s metric:s n:i slope:f intercept:f",
         lambda t: correlation.points_trend(correlation.capture_weather_points(_matched(t))),
         "captures_ev weather_a", f"""
        SELECT variable, metric, count(*) AS n, regr_slope(y, x) AS slope,
               regr_intercept(y, x) AS intercept
        FROM ({_POINTS_SQL}) GROUP BY ALL HAVING n > 10""")
register("weight_by_wind", f"swedish_name:s wind_cat:s {BOX_COLUMNS}",
         lambda t: correlation.weight_by_wind(_at_capture(t), 1, 2), "captures_ev weather_a",
         box_sql(f"""
        WITH g AS (SELECT *, {_cut_sql('wind_speed', *bins.WIND)} AS wind_cat
                   FROM ({_MATCHED_SQL}) WHERE weight > 0)
        SELECT * FROM g WHERE wind_cat IS NOT NULL AND swedish_name IN (
            SELECT swedish_name FROM g WHERE wind_cat IS NOT NULL GROUP BY ALL
            ORDER BY count(*) DESC, swedish_name LIMIT 1)""",
                 "weight", "swedish_name, wind_cat"))

_DIVERSITY_SQL = f"""
        SELECT s.*, total_obs, n_species, n_individuals, {_SEASON_SQL}
        FROM (SELECT date, count(*) AS total_obs, count(DISTINCT species_code) AS n_species,
                     count(DISTINCT ring_number) AS n_individuals
              FROM captures_ev GROUP BY ALL) JOIN ({_DAILY_SQL}) AS s USING (date)"""
_DIVERSITY_VARS = ("mean_temperature", "mean_wind_speed", "mean_visibility", "mean_cloud_cover")


def _diversity(t):
    return correlation.diversity_weather(captures.daily_diversity(t.captures_ev), _daily(t))


register("diversity_weather",
         f"{_DAILY} total_obs:i n_species:i n_individuals:i season:s", _diversity, _ALL,
         _DIVERSITY_SQL)
register("diversity_trend", _FIT,
         lambda t: correlation.ols_trend(
             _diversity(t), "n_individuals", _DIVERSITY_VARS, 10), _ALL,
         _trend_sql(_DIVERSITY_SQL, "n_individuals", _DIVERSITY_VARS, 10))
_BUBBLE_SQL = f"""
        SELECT * FROM ({_DAILY_ALL_SQL}) WHERE captures > 0
          AND mean_temperature IS NOT NULL AND mean_wind_speed IS NOT NULL"""
register("days_with_captures", _DAILY_ALL,
         lambda t: correlation.days_with_captures(_daily_all(t)), _ALL, _BUBBLE_SQL)
register("capture_grid",
         "mean_temperature_cell:i mean_wind_speed_cell:i captures:i n_days:i",
         lambda t: correlation.capture_grid(_daily_all(t)), _ALL, f"""
        WITH d AS ({_BUBBLE_SQL}),
        e AS (SELECT min(mean_temperature) AS t0, max(mean_temperature) AS t1,
                     min(mean_wind_speed) AS w0, max(mean_wind_speed) AS w1 FROM d)
        SELECT least(floor((mean_temperature - t0) / ((t1 - t0) / 25)), 24)
                   AS mean_temperature_cell,
               least(floor((mean_wind_speed - w0) / ((w1 - w0) / 20)), 19)
                   AS mean_wind_speed_cell,
               sum(captures) AS captures, count(*) AS n_days
        FROM d, e GROUP BY ALL""")

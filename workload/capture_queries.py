"""Queries over captures: time series, phenology, body metrics, heat maps, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions.dates import migration_season, ringing_season
from skerry.operators.distribution import flag_outliers
from skerry.operators.filters import (
    between_dates, filled, matching, of_species, of_years, positive, rename_and_order, valid_fat,
)
from skerry.operators.joins import keep_top, merge_metadata, share_of_total, top_by_count
from skerry.plans import body, captures, heatmap, overview, phenology
from workload.registry import register

NAMES = ("name Brand#1", "name Brand#7", "name Brand#12")
CODES = ("Brand#1", "Brand#7", "Brand#12")
NAMES_SQL = ", ".join(f"'{n}'" for n in NAMES)
CODES_SQL = ", ".join(f"'{c}'" for c in CODES)


def quantile_sql(value: str, p: float, method: str) -> str:
    """A quantile over the sorted values of a group, spelled out by position (1-based lists)."""
    values = f"list({value} ORDER BY {value})"
    n = f"count({value})"
    if method == "nearest":
        return f"({values})[CAST(floor(({n} - 1) * {p} + 0.5) AS BIGINT) + 1]"
    low = f"({values})[CAST(floor(({n} - 1) * {p}) AS BIGINT) + 1]"
    high = f"({values})[CAST(ceil(({n} - 1) * {p}) AS BIGINT) + 1]"
    return f"({low} + ({high} - {low}) * (({n} - 1) * {p} - floor(({n} - 1) * {p})))"


def box_sql(source: str, value: str, keys: str) -> str:
    """Box statistics of ``source`` per ``keys``; ``keys`` are comma-separated columns."""
    q1, q2, q3 = (quantile_sql("v", p, "linear") for p in (0.25, 0.5, 0.75))
    same = " AND ".join(f"d.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    inside = "d.v BETWEEN b.q25 - 1.5 * (b.q75 - b.q25) AND b.q75 + 1.5 * (b.q75 - b.q25)"
    return f"""
        WITH d AS (SELECT {keys}, CAST({value} AS DOUBLE) AS v FROM ({source})
                   WHERE {value} IS NOT NULL),
        b AS (SELECT {keys}, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,
                     {q1} AS q25, {q2} AS median, {q3} AS q75, max(v) AS max
              FROM d GROUP BY {keys})
        SELECT b.*, w.lower_whisker, w.upper_whisker, w.n_outliers
        FROM b JOIN (
            SELECT {', '.join('b.' + k.strip() for k in keys.split(','))},
                   min(CASE WHEN {inside} THEN d.v END) AS lower_whisker,
                   max(CASE WHEN {inside} THEN d.v END) AS upper_whisker,
                   sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS n_outliers
            FROM d JOIN b ON {same} GROUP BY ALL
        ) AS w ON {same.replace('d.', 'w.')}"""


BOX_COLUMNS = (
    "n:i mean:f std:f min:f q25:f median:f q75:f max:f lower_whisker:f upper_whisker:f "
    "n_outliers:i"
)

# ---------------------------------------------------------------- time series

_SERIES = ("period:d species_code:s swedish_name:s count:i unique_individuals:i mean_weight:f "
           "mean_wing_length:f")


def _series_sql(period: str, where: str = "TRUE") -> str:
    return f"""
        SELECT {period} AS period, species_code, swedish_name, count(*) AS count,
               count(DISTINCT ring_number) AS unique_individuals, avg(weight) AS mean_weight,
               avg(wing_length) AS mean_wing_length
        FROM captures WHERE {where} GROUP BY ALL"""


register("species_time_series_daily", _SERIES,
         lambda t: captures.species_time_series(t.captures), "captures", _series_sql("date"))
register("species_time_series_weekly", _SERIES,
         lambda t: captures.species_time_series(t.captures, aggregation="weekly"),
         "captures", _series_sql("date_trunc('week', date)"))
register("species_time_series_monthly", _SERIES,
         lambda t: captures.species_time_series(t.captures, aggregation="monthly"),
         "captures", _series_sql("date_trunc('month', date)"))
register("species_time_series_yearly", _SERIES,
         lambda t: captures.species_time_series(
             t.captures, "1997-03-01", "2000-06-30", CODES, "yearly"),
         "captures", _series_sql(
             "date_trunc('year', date)",
             f"date BETWEEN DATE '1997-03-01' AND DATE '2000-06-30' "
             f"AND species_code IN ({CODES_SQL})"))

for unit in ("weekly", "monthly", "yearly"):
    register(f"species_diversity_{unit}", "period:d species_richness:i total_observations:i",
             lambda t, unit=unit: captures.species_diversity(t.captures, unit), "captures", f"""
        SELECT date_trunc('{unit.removesuffix('ly')}', date) AS period,
               count(DISTINCT species_code) AS species_richness, count(*) AS total_observations
        FROM captures GROUP BY ALL""")

register("daily_diversity", "date:d total_obs:i n_species:i n_individuals:i",
         lambda t: captures.daily_diversity(t.captures, "1996-01-01", "2000-12-31"),
         "captures", """
        SELECT date, count(*) AS total_obs, count(DISTINCT species_code) AS n_species,
               count(DISTINCT ring_number) AS n_individuals
        FROM captures WHERE year(date) BETWEEN 1996 AND 2000 GROUP BY ALL""")
register("daily_counts",
         "date:d species_code:s count:i mean_weight:f std_weight:f mean_wing_length:f "
         "std_wing_length:f",
         lambda t: captures.daily_counts(t.captures), "captures", """
        SELECT date, species_code, count(*) AS count, avg(weight) AS mean_weight,
               stddev_samp(weight) AS std_weight, avg(wing_length) AS mean_wing_length,
               stddev_samp(wing_length) AS std_wing_length
        FROM captures GROUP BY ALL""")
register("daily_total", "date:d count:i", lambda t: captures.daily_total(t.captures), "captures",
         "SELECT date, count(*) AS count FROM captures GROUP BY ALL")
register("pivot_species_time", "date:d " + " ".join(f"Brand#{i}:i" for i in range(1, 26)),
         lambda t: captures.pivot_by_time(
             t.captures, values=[f"Brand#{i}" for i in range(1, 26)]),
         "captures", "SELECT date, " + ", ".join(
             f"nullif(count(*) FILTER (WHERE species_code = 'Brand#{i}'), 0) AS \"Brand#{i}\""
             for i in range(1, 26)) + " FROM captures GROUP BY ALL")
register("time_features",
         "year:i month:i day:i weekday:i day_of_year:i week_of_year:i season:s n:i",
         lambda t: captures.add_time_features(t.captures).groupBy(
             "year", "month", "day", "weekday", "day_of_year", "week_of_year", "season"
         ).agg(F.count(F.lit(1)).alias("n")), "captures", """
        SELECT year(date) AS year, month(date) AS month, day(date) AS day,
               isodow(date) AS weekday, dayofyear(date) AS day_of_year,
               weekofyear(date) AS week_of_year,
               ['Winter', 'Spring', 'Summer', 'Autumn'][month(date) % 12 // 3 + 1] AS season,
               count(*) AS n
        FROM captures GROUP BY ALL""")
register("season_variants", "ringing:s migration:s month:i n:i",
         lambda t: t.captures.groupBy(
             ringing_season(F.month("date")).alias("ringing"),
             migration_season(F.month("date")).alias("migration"),
             F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("n")), "captures", """
        SELECT CASE WHEN month(date) BETWEEN 3 AND 5 THEN 'Spring'
                    WHEN month(date) BETWEEN 6 AND 7 THEN 'Summer'
                    WHEN month(date) BETWEEN 8 AND 11 THEN 'Autumn' ELSE 'Winter' END AS ringing,
               CASE WHEN month(date) BETWEEN 3 AND 5 THEN 'spring'
                    WHEN month(date) BETWEEN 8 AND 10 THEN 'autumn' ELSE 'other' END AS migration,
               month(date) AS month, count(*) AS n
        FROM captures GROUP BY ALL""")

# ---------------------------------------------------------------- filters

_ROW = "date:d time:f ring_number:s species_code:s weight:f wing_length:i fat_score:i"
_ROW_SQL = "SELECT date, time, ring_number, species_code, weight, wing_length, fat_score FROM captures"

register("filter_date_range", _ROW,
         lambda t: between_dates(t.captures, "1998-02-01", "1998-02-28"), "captures",
         f"{_ROW_SQL} WHERE date >= DATE '1998-02-01' AND date < DATE '1998-03-01'")
register("filter_species", _ROW, lambda t: of_species(t.captures, CODES), "captures",
         f"{_ROW_SQL} WHERE species_code IN ({CODES_SQL})")
register("filter_years", _ROW, lambda t: of_years(t.captures, 1999, 1999), "captures",
         f"{_ROW_SQL} WHERE year(date) = 1999")
register("filter_valid_measures", "species_code:s n:i",
         lambda t: t.captures.where(
             positive("weight") & positive("wing_length") & valid_fat() & filled("age")
             & filled("ringer")).groupBy("species_code").agg(F.count(F.lit(1)).alias("n")),
         "captures", """
        SELECT species_code, count(*) AS n FROM captures
        WHERE weight > 0 AND wing_length > 0 AND fat_score >= 0 AND fat_score <= 10
          AND coalesce(age, '') <> '' AND coalesce(ringer, '') <> '' GROUP BY ALL""")
register("filter_by_mapping", _ROW,
         lambda t: matching(
             t.captures, {"species_code": list(CODES), "age": "A", "fat_score": 3}), "captures",
         f"{_ROW_SQL} WHERE species_code IN ({CODES_SQL}) AND age = 'A' AND fat_score = 3")
register("rename_and_order", "day:d species:s ring_number:s weight:f",
         lambda t: rename_and_order(
             t.captures.select("weight", "ring_number", "species_code", "date", "age"),
             {"date": "day", "species_code": "species"}, ["day", "species"], ["age"]), "captures",
         "SELECT date AS day, species_code AS species, ring_number, weight FROM captures")

# ---------------------------------------------------------------- individuals and ringers

register("recapture_analysis",
         "ring_number:s species_code:s first_capture:d last_capture:d n_captures:i "
         "n_capture_days:i days_between:i years_between:f",
         lambda t: captures.recapture_analysis(t.captures), "captures", """
        SELECT *, date_diff('day', first_capture, last_capture) AS days_between,
               round(date_diff('day', first_capture, last_capture) / CAST(365.25 AS DOUBLE), 2)
                   AS years_between
        FROM (SELECT ring_number, species_code, min(date) AS first_capture,
                     max(date) AS last_capture, count(*) AS n_captures,
                     count(DISTINCT date) AS n_capture_days
              FROM captures WHERE coalesce(ring_number, '') <> '' GROUP BY ALL)
        WHERE n_captures > 1""")
register("recapture_stats",
         "ring_number:s n_captures:i first_capture:d last_capture:d species_code:s days_between:i",
         lambda t: captures.recapture_stats(t.captures), "captures", """
        SELECT ring_number, count(*) AS n_captures, min(date) AS first_capture,
               max(date) AS last_capture,
               (list(species_code ORDER BY date, species_code))[1] AS species_code,
               date_diff('day', min(date), max(date)) AS days_between
        FROM captures GROUP BY ring_number HAVING n_captures > 1""")
register("ringer_statistics",
         "ringer:s total_rings:i unique_species:i active_days:i first_record:d last_record:d",
         lambda t: captures.ringer_statistics(t.captures, "1996-01-01", "2000-12-31"),
         "captures", """
        SELECT ringer, count(*) AS total_rings, count(DISTINCT species_code) AS unique_species,
               count(DISTINCT date) AS active_days, min(date) AS first_record,
               max(date) AS last_record
        FROM captures WHERE year(date) BETWEEN 1996 AND 2000 AND length(ringer) > 0
        GROUP BY ALL""")
register("ringer_activity", "date:d ringer:s count:i",
         lambda t: captures.ringer_activity(t.captures), "captures", """
        SELECT date, ringer, count(*) AS count FROM captures
        WHERE ringer IN (SELECT ringer FROM captures GROUP BY ringer
                         ORDER BY count(*) DESC, ringer LIMIT 10)
        GROUP BY ALL""")
register("year_over_year",
         "species_code:s swedish_name:s year:i count:i prev_year_count:i absolute_change:i "
         "percent_change:f",
         lambda t: captures.year_over_year(t.captures), "captures", """
        WITH y AS (SELECT *, row_number() OVER (PARTITION BY species_code ORDER BY year) AS i
                   FROM (SELECT species_code, swedish_name, year(date) AS year,
                                count(*) AS count FROM captures GROUP BY ALL))
        SELECT a.species_code, a.swedish_name, a.year, a.count, b.count AS prev_year_count,
               a.count - b.count AS absolute_change,
               round(CAST(100 AS DOUBLE) * (a.count - b.count) / b.count, 2) AS percent_change
        FROM y AS a LEFT JOIN y AS b ON a.species_code = b.species_code AND a.i = b.i + 1""")

# ---------------------------------------------------------------- phenology

_UNIT = {"daily": ("day_of_year", "dayofyear(date)"), "weekly": ("week_of_year", "weekofyear(date)")}
for rhythm, (unit, part) in _UNIT.items():
    build = phenology.phenology_daily if rhythm == "daily" else phenology.phenology_weekly
    register(f"phenology_{rhythm}_by_year",
             f"species_code:s swedish_name:s year:i {unit}:i count:i",
             lambda t, build=build: build(t.captures, aggregate_years=False), "captures", f"""
        SELECT species_code, swedish_name, year(date) AS year, {part} AS {unit},
               count(*) AS count FROM captures GROUP BY ALL""")
    register(f"phenology_{rhythm}",
             f"species_code:s swedish_name:s {unit}:i total_count:i avg_count:f std_count:f "
             "n_years:i",
             lambda t, build=build: build(t.captures, start_year=1996, end_year=2000),
             "captures", f"""
        SELECT species_code, swedish_name, {unit}, sum(c) AS total_count, avg(c) AS avg_count,
               stddev_samp(c) AS std_count, count(*) AS n_years
        FROM (SELECT species_code, swedish_name, year(date) AS y, {part} AS {unit},
                     count(*) AS c
              FROM captures WHERE year(date) BETWEEN 1996 AND 2000 GROUP BY ALL)
        GROUP BY ALL""")

_CHOSEN = f"species_code IN ({CODES_SQL}) AND year(date) BETWEEN 1997 AND 1999"
register("ridgeline_selection",
         "species_code:s swedish_name:s day_of_year:i total_count:i avg_count:f std_count:f "
         "n_years:i",
         lambda t: phenology.in_years_of(
             phenology.phenology_daily, t.captures, CODES, "1997-06-15", "1999-02-01"),
         "captures", f"""
        SELECT species_code, swedish_name, doy AS day_of_year, sum(c) AS total_count,
               avg(c) AS avg_count, stddev_samp(c) AS std_count, count(*) AS n_years
        FROM (SELECT species_code, swedish_name, dayofyear(date) AS doy, count(*) AS c
              FROM captures WHERE {_CHOSEN} GROUP BY species_code, swedish_name, doy, year(date)) GROUP BY ALL""")
register("yearly_selection", "species_code:s swedish_name:s year:i week_of_year:i count:i",
         lambda t: phenology.in_years_of(
             phenology.phenology_weekly, t.captures, CODES, "1997-06-15", "1999-02-01",
             aggregate_years=False), "captures", f"""
        SELECT species_code, swedish_name, year(date) AS year,
               weekofyear(date) AS week_of_year, count(*) AS count
        FROM captures WHERE {_CHOSEN} GROUP BY ALL""")

register("phenology_by_species",
         "species_code:s swedish_name:s year:i first_day_of_year:i q25_day_of_year:i "
         "median_day_of_year:i q75_day_of_year:i last_day_of_year:i n_observations:i",
         lambda t: phenology.phenology_by_species(t.captures), "captures", """
        WITH d AS (SELECT *, dayofyear(date) AS doy, year(date) AS year FROM captures)
        SELECT species_code, swedish_name, year, min(doy) AS first_day_of_year,
               quantile_disc(doy, 0.25) AS q25_day_of_year,
               quantile_disc(doy, 0.5) AS median_day_of_year,
               quantile_disc(doy, 0.75) AS q75_day_of_year, max(doy) AS last_day_of_year,
               count(*) AS n_observations
        FROM d GROUP BY species_code, swedish_name, year""")

_WINDOWS_SQL = """
        SELECT species_code, swedish_name, year, season, count(*) AS n_observations,
               min(doy) AS first_obs, quantile_disc(doy, 0.25) AS q25,
               quantile_disc(doy, 0.5) AS median, quantile_disc(doy, 0.75) AS q75,
               max(doy) AS last_obs,
               quantile_disc(doy, 0.75) - quantile_disc(doy, 0.25) AS iqr_days
        FROM (SELECT species_code, swedish_name, year(date) AS year, dayofyear(date) AS doy,
                     if(month(date) < 6, 'spring', 'autumn') AS season
              FROM captures WHERE month(date) IN (3, 4, 5, 8, 9, 10))
        GROUP BY species_code, swedish_name, year, season"""
register("migration_windows",
         "species_code:s swedish_name:s year:i season:s n_observations:i first_obs:i q25:i "
         "median:i q75:i last_obs:i iqr_days:i",
         lambda t: phenology.migration_windows(t.captures), "captures", _WINDOWS_SQL)
register("seasonal_average",
         "swedish_name:s season:s median:f q25:f q75:f n_observations:i above_median:f "
         "below_median:f",
         lambda t: phenology.seasonal_average(phenology.migration_windows(t.captures)),
         "captures", f"""
        SELECT swedish_name, season, avg(median) AS median, avg(q25) AS q25, avg(q75) AS q75,
               sum(n_observations) AS n_observations, avg(q75) - avg(median) AS above_median,
               avg(median) - avg(q25) AS below_median
        FROM ({_WINDOWS_SQL}) GROUP BY swedish_name, season""")
register("phenology_metrics",
         "species_code:s swedish_name:s year:i first_arrival_day:i q25_arrival_day:f "
         "median_arrival_day:f q75_arrival_day:f last_departure_day:i n_observations:i",
         lambda t: phenology.phenology_metrics(t.captures), "captures", f"""
        SELECT species_code, swedish_name, year, min(doy) AS first_arrival_day,
               {quantile_sql('doy', 0.25, 'nearest')} AS q25_arrival_day,
               median(doy) AS median_arrival_day,
               {quantile_sql('doy', 0.75, 'nearest')} AS q75_arrival_day,
               max(doy) AS last_departure_day, count(*) AS n_observations
        FROM (SELECT species_code, swedish_name, year(date) AS year, dayofyear(date) AS doy
              FROM captures) GROUP BY species_code, swedish_name, year""")
register("monthly_counts", "species_code:s swedish_name:s year:i month:i count:i",
         lambda t: phenology.monthly_counts(t.captures, CODES, 1997), "captures", f"""
        SELECT species_code, swedish_name, year(date) AS year, month(date) AS month,
               count(*) AS count
        FROM captures WHERE species_code IN ({CODES_SQL}) AND year(date) >= 1997 GROUP BY ALL""")
register("top_months", "swedish_name:s month:i total:i rank:i",
         lambda t: phenology.top_months(phenology.monthly_counts(t.captures)), "captures", """
        SELECT *, row_number() OVER (PARTITION BY swedish_name ORDER BY total DESC, month) AS rank
        FROM (SELECT swedish_name, month(date) AS month, count(*) AS total
              FROM captures GROUP BY ALL) QUALIFY rank <= 3""")
register("peak_day", "swedish_name:s peak_day:i total_observations:i n_days:i",
         lambda t: phenology.peak_day(phenology.phenology_daily(t.captures)), "captures", """
        SELECT swedish_name, (list(doy ORDER BY mean DESC, doy))[1] AS peak_day,
               sum(total) AS total_observations, count(*) AS n_days
        FROM (SELECT swedish_name, doy, sum(c) AS total, avg(c) AS mean
              FROM (SELECT swedish_name, dayofyear(date) AS doy, count(*) AS c
                    FROM captures GROUP BY swedish_name, dayofyear(date), year(date))
              GROUP BY swedish_name, doy)
        GROUP BY swedish_name""")
register("species_week_matrix", "swedish_name:s " + " ".join(f"{w}:f" for w in range(1, 54)),
         lambda t: phenology.species_week_matrix(phenology.phenology_weekly(t.captures)),
         "captures", "SELECT swedish_name, " + ", ".join(
             f'coalesce(avg(c) FILTER (WHERE week = {w}), 0) AS "{w}"' for w in range(1, 54)
         ) + """ FROM (SELECT swedish_name, weekofyear(date) AS week, count(*) AS c
              FROM captures GROUP BY swedish_name, weekofyear(date), year(date))
        GROUP BY swedish_name""")
register("species_trend", "week:i swedish_name:s count:f",
         lambda t: phenology.species_trend(t.captures), "captures", """
        SELECT weekofyear(date) AS week, swedish_name,
               count(*) / (SELECT CAST(count(DISTINCT year(date)) AS DOUBLE) FROM captures)
                   AS count
        FROM captures WHERE swedish_name IN (
            SELECT swedish_name FROM captures GROUP BY ALL
            ORDER BY count(*) DESC, swedish_name LIMIT 10)
        GROUP BY weekofyear(date), swedish_name""")
register("seasonality_histogram", "swedish_name:s first_day:i count:i",
         lambda t: phenology.seasonality_histogram(t.captures), "captures", """
        SELECT swedish_name, (dayofyear(date) - 1) // 5 * 5 + 1 AS first_day, count(*) AS count
        FROM captures GROUP BY ALL""")
register("species_week_density", "swedish_name:s week:i count:i",
         lambda t: phenology.species_week_density(t.captures, NAMES), "captures", f"""
        SELECT swedish_name, weekofyear(date) AS week, count(*) AS count
        FROM captures WHERE swedish_name IN ({NAMES_SQL}) GROUP BY ALL""")

# ---------------------------------------------------------------- body metrics

register("morphometric_distributions",
         "species_code:s swedish_name:s weight:f wing_length:i age:s year:i month:i",
         lambda t: body.morphometric_distributions(t.captures, CODES, 1999), "captures", f"""
        SELECT species_code, swedish_name, weight, wing_length, age, year(date) AS year,
               month(date) AS month
        FROM captures WHERE weight IS NOT NULL AND wing_length IS NOT NULL
          AND species_code IN ({CODES_SQL}) AND year(date) = 1999""")
for metric, keys in (("weight", "species_code age"), ("wing_length", "age"),
                     ("fat_score", "ringer")):
    grouped = keys.replace(" ", ", ")
    register(f"body_metrics_{metric}",
             " ".join(f"{k}:s" for k in keys.split()) + " n:i " + " ".join(
                 f"{s}_{metric}:f"
                 for s in ("mean", "std", "min", "q25", "median", "q75", "max")),
             lambda t, metric=metric, keys=keys: body.body_metrics(
                 t.captures, metric, keys.split()), "captures", f"""
        SELECT {grouped}, count({metric}) AS n, avg({metric}) AS mean_{metric},
               stddev_samp({metric}) AS std_{metric}, min({metric}) AS min_{metric},
               quantile_disc({metric}, 0.25) AS q25_{metric},
               quantile_disc({metric}, 0.5) AS median_{metric},
               quantile_disc({metric}, 0.75) AS q75_{metric}, max({metric}) AS max_{metric}
        FROM captures WHERE {metric} IS NOT NULL GROUP BY {grouped}""")


def _weight_sql(unit: str, part: str, where: str = "TRUE") -> str:
    return f"""
        SELECT species_code, swedish_name, {part} AS {unit}, avg(weight) AS mean_weight,
               min(weight) AS min_weight, max(weight) AS max_weight, count(*) AS n
        FROM captures WHERE weight > 0 AND {where} GROUP BY ALL"""


_WEIGHT = "species_code:s swedish_name:s {}:i mean_weight:f min_weight:f max_weight:f n:i"
register("weekly_weight", _WEIGHT.format("week_of_year"),
         lambda t: body.weekly_weight(t.captures, year=1998), "captures",
         _weight_sql("week_of_year", "weekofyear(date)", "year(date) = 1998"))
register("weekly_weight_all_years", _WEIGHT.format("week_of_year"),
         lambda t: body.weekly_weight_for(t.captures, CODES, "1996-05-01", "2000-04-30"),
         "captures", _weight_sql(
             "week_of_year", "weekofyear(date)",
             f"species_code IN ({CODES_SQL}) "
             "AND date BETWEEN DATE '1996-05-01' AND DATE '2000-04-30'"))
register("yearly_weight", _WEIGHT.format("year"),
         lambda t: body.yearly_weight(t.captures), "captures", _weight_sql("year", "year(date)"))

for measure in ("weight", "wing_length"):
    register(f"{measure}_box", f"swedish_name:s {BOX_COLUMNS}",
             lambda t, measure=measure: body.measure_box(
                 t.captures, measure, None, "1996-01-01", "2000-12-31"), "captures",
             box_sql(f"SELECT * FROM captures WHERE {measure} > 0 "
                     "AND year(date) BETWEEN 1996 AND 2000", measure, "swedish_name"))
register("age_distribution", "swedish_name:s age:s count:i total:i percentage:f",
         lambda t: body.age_distribution(t.captures), "captures", """
        SELECT c.*, s.total, c.count * CAST(100 AS DOUBLE) / s.total AS percentage
        FROM (SELECT swedish_name, age, count(*) AS count FROM captures
              WHERE age <> '' GROUP BY ALL) AS c
        JOIN (SELECT swedish_name, count(*) AS total FROM captures
              WHERE age <> '' GROUP BY ALL) AS s USING (swedish_name)""")
register("age_code_counts", "swedish_name:s age_code:s count:i",
         lambda t: body.age_code_counts(t.captures, NAMES), "captures", f"""
        SELECT swedish_name, age_code, count(*) AS count
        FROM captures WHERE swedish_name IN ({NAMES_SQL}) GROUP BY ALL""")
register("fat_score", "swedish_name:s mean_fat_score:f std_fat_score:f count:i",
         lambda t: body.fat_score(t.captures), "captures", """
        SELECT swedish_name, avg(fat_score) AS mean_fat_score,
               stddev_samp(fat_score) AS std_fat_score, count(*) AS count
        FROM captures WHERE fat_score BETWEEN 0 AND 10 GROUP BY ALL""")
register("outliers_iqr", "ring_number:s date:d time:f weight:f weight_outlier:b",
         lambda t: flag_outliers(t.captures, "weight", "iqr", 0.5), "captures", f"""
        WITH q AS (SELECT {quantile_sql('weight', 0.25, 'nearest')} AS a,
                          {quantile_sql('weight', 0.75, 'nearest')} AS b
                   FROM captures WHERE weight IS NOT NULL)
        SELECT ring_number, date, time, weight,
               weight < a - 0.5 * (b - a) OR weight > b + 0.5 * (b - a) AS weight_outlier
        FROM captures, q""")
register("outliers_zscore", "ring_number:s date:d time:f weight:f weight_outlier:b",
         lambda t: flag_outliers(t.captures, "weight", "zscore", 1.5), "captures", """
        SELECT ring_number, date, time, weight,
               abs(weight - (SELECT avg(weight) FROM captures))
                   / (SELECT stddev_samp(weight) FROM captures) > 1.5 AS weight_outlier
        FROM captures""")

# ---------------------------------------------------------------- heat maps

_HEAT_BASE = """
        WITH w AS (SELECT species_code, swedish_name, weekofyear(date) AS week_of_year,
                          count(*) AS c, count(DISTINCT year(date)) AS years
                   FROM captures WHERE {where} GROUP BY ALL),
        s AS (SELECT species_code, sum(c) AS total_count, avg(years) AS years_seen,
                     row_number() OVER (ORDER BY sum(c) DESC, species_code) AS place
              FROM w GROUP BY species_code)"""
_HEAT_YEAR_SQL = _HEAT_BASE.format(where="year(date) = 1999") + """
        SELECT w.species_code, swedish_name, week_of_year, c AS count, total_count,
               round(CAST(100 AS DOUBLE) * c / total_count, 2) AS percent_of_total
        FROM w JOIN s ON w.species_code = s.species_code AND place <= 10"""
_HEAT_AVG_SQL = _HEAT_BASE.format(where="TRUE") + """
        SELECT w.species_code, swedish_name, week_of_year,
               round(c / CAST(years AS DOUBLE), 1) AS avg_count, total_count,
               round(CAST(100 AS DOUBLE) * (c / CAST(years AS DOUBLE))
                     / (total_count / years_seen), 2) AS percent_of_total
        FROM w JOIN s ON w.species_code = s.species_code AND place <= 20"""
register("weekly_heatmap_year",
         "species_code:s swedish_name:s week_of_year:i count:i total_count:i percent_of_total:f",
         lambda t: heatmap.weekly_heatmap(t.captures, 1999, 10), "captures", _HEAT_YEAR_SQL)
register("weekly_heatmap_avg",
         "species_code:s swedish_name:s week_of_year:i avg_count:f total_count:i "
         "percent_of_total:f",
         lambda t: heatmap.weekly_heatmap(t.captures, None, 20), "captures", _HEAT_AVG_SQL)
register("heatmap_matrix", "swedish_name:s " + " ".join(f"{w}:f" for w in range(1, 54)),
         lambda t: heatmap.heatmap_matrix(heatmap.weekly_heatmap(t.captures, None, 20), 53),
         "captures", "SELECT swedish_name, " + ", ".join(
             f'coalesce(max(percent_of_total) FILTER (WHERE week_of_year = {w}), 0) AS "{w}"'
             for w in range(1, 54)) + f" FROM ({_HEAT_AVG_SQL}) GROUP BY swedish_name")

# ---------------------------------------------------------------- summaries

register("species_summary",
         "species_code:s swedish_name:s scientific_name:s total_records:i unique_individuals:i "
         "first_sighting:d last_sighting:d mean_weight:f std_weight:f mean_wing_length:f "
         "std_wing_length:f mean_fat_score:f most_common_age:s",
         lambda t: overview.species_summary(t.captures), "captures", """
        WITH ages AS (SELECT species_code, (list(age ORDER BY n DESC, age))[1] AS age
                      FROM (SELECT species_code, age, count(*) AS n FROM captures GROUP BY ALL)
                      GROUP BY species_code)
        SELECT species_code, swedish_name, scientific_name, count(*) AS total_records,
               count(DISTINCT ring_number) + max(if(ring_number IS NULL, 1, 0))
                   AS unique_individuals,
               min(date) AS first_sighting, max(date) AS last_sighting,
               avg(weight) AS mean_weight, stddev_samp(weight) AS std_weight,
               avg(wing_length) AS mean_wing_length,
               stddev_samp(wing_length) AS std_wing_length,
               avg(fat_score) AS mean_fat_score, max(ages.age) AS most_common_age
        FROM captures JOIN ages USING (species_code)
        GROUP BY species_code, swedish_name, scientific_name""")
register("summary_stats",
         "total_records:i first_date:d last_date:d unique_species:i unique_ringers:i",
         lambda t: overview.summary_stats(t.captures), "captures", """
        SELECT count(*) AS total_records, min(date) AS first_date, max(date) AS last_date,
               count(DISTINCT species_code) AS unique_species,
               count(DISTINCT ringer) AS unique_ringers FROM captures""")
register("top_species", "species_code:s swedish_name:s count:i",
         lambda t: captures.top_species(t.captures), "captures", """
        SELECT species_code, swedish_name, count(*) AS count FROM captures GROUP BY ALL
        ORDER BY count DESC, species_code LIMIT 10""")
register("selection_summary",
         "total_records:i unique_species:i unique_individuals:i first_date:d last_date:d",
         lambda t: overview.selection_summary(t.captures, "1997-01-01", "1999-12-31", CODES),
         "captures", f"""
        SELECT count(*) AS total_records,
               count(DISTINCT species_code) + coalesce(max(if(species_code IS NULL, 1, 0)), 0)
                   AS unique_species,
               count(DISTINCT ring_number) + coalesce(max(if(ring_number IS NULL, 1, 0)), 0)
                   AS unique_individuals, min(date) AS first_date, max(date) AS last_date
        FROM captures WHERE year(date) BETWEEN 1997 AND 1999
          AND species_code IN ({CODES_SQL})""")
register("species_options", "species_code:s swedish_name:s",
         lambda t: overview.species_options(t.captures), "captures",
         "SELECT species_code, swedish_name FROM captures GROUP BY ALL")
register("year_options", "year:i", lambda t: overview.year_options(t.captures), "captures",
         "SELECT year(date) AS year FROM captures GROUP BY ALL")
register("date_bounds", "first_date:d last_date:d",
         lambda t: overview.date_bounds(t.captures), "captures",
         "SELECT min(date) AS first_date, max(date) AS last_date FROM captures")
register("yearly_description",
         "n:i mean:f std:f min:f q25:f median:f q75:f max:f",
         lambda t: captures.yearly_description(t.captures), "captures", """
        SELECT count(*) AS n, avg(c) AS mean, stddev_samp(c) AS std, min(c) AS min,
               quantile_cont(c, 0.25) AS q25, quantile_cont(c, 0.5) AS median,
               quantile_cont(c, 0.75) AS q75, max(c) AS max
        FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM captures GROUP BY year(date))""")
_CAPTURE = "date time ring_number species_code swedish_name scientific_name age age_code ringer weight wing_length fat_score".split()
register("column_profile", "column:s non_null:i smallest:s largest:s",
         lambda t: overview.column_profile(t.captures), "captures", " UNION ALL ".join(
             f"SELECT '{c}' AS column, count({c}) AS non_null, "
             f"CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest "
             "FROM captures" for c in _CAPTURE))

# ---------------------------------------------------------------- joins

for how in ("left", "inner", "outer"):
    register(f"merge_metadata_{how}", "ringer:s name:s n:i balance:f",
             lambda t, how=how: merge_metadata(
                 t.captures.groupBy("ringer").agg(F.count(F.lit(1)).alias("n")),
                 t.raw("supplier").select(
                     F.when(F.col("s_suppkey") % 3 == 1, F.col("s_suppkey").cast("string"))
                     .otherwise(F.concat(F.lit("x"), "s_suppkey")).alias("ringer"),
                     F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
                 "ringer", how), "captures", f"""
        SELECT ringer, name, n, balance
        FROM (SELECT ringer, count(*) AS n FROM captures GROUP BY ALL)
        {'FULL' if how == 'outer' else how.upper()} JOIN (
            SELECT if(s_suppkey % 3 = 1, '', 'x') || s_suppkey AS ringer, s_name AS name,
                   s_acctbal AS balance FROM supplier
        ) USING (ringer)""")
register("keep_top_species", "species_code:s age:s n:i",
         lambda t: keep_top(t.captures, "species_code", 5).groupBy("species_code", "age").agg(
             F.count(F.lit(1)).alias("n")), "captures", """
        SELECT species_code, age, count(*) AS n FROM captures WHERE species_code IN (
            SELECT species_code FROM captures GROUP BY ALL
            ORDER BY count(*) DESC, species_code LIMIT 5) GROUP BY ALL""")
register("top_ringers", "ringer:s count:i",
         lambda t: top_by_count(t.captures, ["ringer"], 10), "captures", """
        SELECT ringer, count(*) AS count FROM captures GROUP BY ALL
        ORDER BY count DESC, ringer LIMIT 10""")
register("share_of_total", "species_code:s year:i count:i total:i percent:f",
         lambda t: share_of_total(
             t.captures.groupBy("species_code", F.year("date").alias("year")).agg(
                 F.count(F.lit(1)).alias("count")),
             "count", ["species_code"], "total", "percent"), "captures", """
        SELECT *, CAST(100 AS DOUBLE) * count / total AS percent
        FROM (SELECT species_code, year(date) AS year, count(*) AS count FROM captures
              GROUP BY ALL)
        JOIN (SELECT species_code, count(*) AS total FROM captures GROUP BY ALL)
        USING (species_code)""")

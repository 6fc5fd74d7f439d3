"""Views that give the test tables the shape of station data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.plans.weather import to_long
from skerry.schemas import WEATHER_MEASURES

BACKED_UP = ("precipitation", "pressure", "visibility")


class Tables:
    """Lazily built views over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def captures(self) -> DataFrame:
        """Line items as captures: the part's brand is the species, the part the bird."""
        items = self.raw("lineitem").join(
            self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return items.select(
            F.col("l_shipdate").cast("date").alias("date"),
            (F.lit(3) + F.col("l_linenumber") + F.col("l_orderkey") % 60 / F.lit(60.0)).alias(
                "time"),
            F.col("l_partkey").cast("string").alias("ring_number"),
            F.col("p_brand").alias("species_code"),
            F.concat(F.lit("name "), "p_brand").alias("swedish_name"),
            F.concat(F.lit("sci "), "p_brand").alias("scientific_name"),
            F.col("l_returnflag").alias("age"), F.col("l_linestatus").alias("age_code"),
            F.col("l_suppkey").cast("string").alias("ringer"),
            F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("weight"),
            F.col("p_size").alias("wing_length"), F.col("l_linenumber").alias("fat_score"),
        )

    @property
    def captures_ev(self) -> DataFrame:
        """User events as captures with a record id and a time of day."""
        events = self.raw("events").where(F.col("event_type").isin("click", "purchase", "signup"))
        return events.select(
            F.col("event_id").alias("record_id"), F.col("ts").cast("date").alias("date"),
            (F.hour("ts") + F.minute("ts") / F.lit(60.0)).alias("time"),
            F.col("user_id").cast("string").alias("ring_number"),
            F.col("event_type").alias("species_code"), F.col("event_type").alias("swedish_name"),
            F.when(F.col("event_id") % 2 == 0, "2K").otherwise("1K").alias("age"),
            F.col("value").alias("weight"),
            (F.lit(50) + F.col("user_id") % 40).cast("int").alias("wing_length"),
            (F.col("event_id") % 12).cast("int").alias("fat_score"),
            (F.col("event_id") % 4).cast("int").alias("muscle_score"),
        )

    def _weather(self, kind: str) -> DataFrame:
        hourly = self.raw("events").where(F.col("event_type") == kind).groupBy(
            F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("observation_time")
        ).agg(
            F.avg("value").alias("temperature"), F.sum("value").alias("wind_direction"),
            F.min("value").alias("wind_speed"),
            F.count(F.lit(1)).cast("double").alias("humidity"),
            (F.max("value") - F.min("value")).alias("cloud_cover"),
            F.max("value").alias("gust_wind"),
        )
        quality = F.when(F.col("humidity") > 2, "G").otherwise("Y")
        return hourly.withColumns({
            **{name: F.col("wind_direction") for name in BACKED_UP},
            **{f"{name}_quality": quality for name in WEATHER_MEASURES},
        })

    @property
    def weather_a(self) -> DataFrame:
        """Hourly weather; rain, pressure and visibility are missing in hours with one event."""
        alone = F.col("humidity") == 1
        return self._weather("view").withColumns({
            name: F.when(~alone, F.col(name)) for name in BACKED_UP})

    @property
    def weather_b(self) -> DataFrame:
        """The backup station."""
        return self._weather("error")

    def over_the_year(self, df: DataFrame, on: str) -> DataFrame:
        """The days of one month set 13 days apart, so that they cover months and seasons."""
        ahead = F.make_dt_interval(days=F.dayofmonth(on) * 12)
        return df.withColumn(on, (F.col(on) + ahead).cast(df.schema[on].dataType))

    @property
    def weather_a_year(self) -> DataFrame:
        return self.over_the_year(self.weather_a, "observation_time")

    @property
    def weather_b_year(self) -> DataFrame:
        return self.over_the_year(self.weather_b, "observation_time")

    @property
    def captures_ev_year(self) -> DataFrame:
        return self.over_the_year(self.captures_ev, "date")

    @property
    def weather_long(self) -> DataFrame:
        """weather_a as (time, parameter, value, priority), odd hours again at priority 2."""
        first = to_long(self.weather_a).withColumn("priority", F.lit(1))
        again = first.where(F.hour("observation_time") % 2 == 1).withColumns({
            "value": F.col("value") + 1, "priority": F.lit(2)})
        return first.unionByName(again)

    @property
    def observations(self) -> DataFrame:
        """Orders as public observations scattered around the station."""
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            key.cast("string").alias("OccurrenceId"), F.col("o_orderdate").alias("StartDate"),
            (F.col("o_orderdate") + F.make_dt_interval(days=(key % 3).cast("int"))).alias(
                "EndDate"),
            (F.lit(57.30) + (customer % 200 - 100) / F.lit(1000.0)).alias("DecimalLatitude"),
            (F.lit(11.90) + (key % 200 - 100) / F.lit(1000.0)).alias("DecimalLongitude"),
            (customer % 50).cast("int").alias("DyntaxaTaxonId"),
            (key % 3).cast("int").alias("DataProviderId"),
            F.col("o_totalprice").alias("price"),
        )

    @property
    def taxonomy(self) -> DataFrame:
        """The taxa of the observations as a tree: the parent of n is n / 2."""
        taxa = self.observations.select(F.col("DyntaxaTaxonId").alias("taxon_id")).distinct()
        return taxa.withColumn("parent_id", F.floor(F.col("taxon_id") / 2).cast("int"))


def _weather_sql(kind: str, measure: str) -> str:
    quality = ", ".join(
        f"CASE WHEN count(*) > 2 THEN 'G' ELSE 'Y' END AS {m}_quality" for m in WEATHER_MEASURES)
    return f"""
        SELECT date_trunc('hour', ts) AS observation_time, avg(value) AS temperature,
               sum(value) AS wind_direction, min(value) AS wind_speed,
               CAST(count(*) AS DOUBLE) AS humidity, max(value) - min(value) AS cloud_cover,
               max(value) AS gust_wind, {measure} AS precipitation, {measure} AS pressure,
               {measure} AS visibility, {quality}
        FROM events WHERE event_type = '{kind}' GROUP BY 1"""


_LONG = " UNION ALL ".join(
    f"SELECT observation_time, '{m}' AS parameter, {m} AS value FROM weather_a "
    f"WHERE {m} IS NOT NULL" for m in WEATHER_MEASURES)

# View name: the views it reads, and its SELECT.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "captures": ((), """
        SELECT CAST(l_shipdate AS DATE) AS date,
               3 + l_linenumber + CAST(l_orderkey % 60 AS DOUBLE) / 60 AS time,
               CAST(l_partkey AS VARCHAR) AS ring_number, p_brand AS species_code,
               'name ' || p_brand AS swedish_name, 'sci ' || p_brand AS scientific_name,
               l_returnflag AS age, l_linestatus AS age_code,
               CAST(l_suppkey AS VARCHAR) AS ringer,
               CASE WHEN l_quantity > 2 THEN l_quantity END AS weight,
               p_size AS wing_length, l_linenumber AS fat_score
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "captures_ev": ((), """
        SELECT event_id AS record_id, CAST(ts AS DATE) AS date,
               extract(hour FROM ts) + CAST(extract(minute FROM ts) AS DOUBLE) / 60 AS time,
               CAST(user_id AS VARCHAR) AS ring_number, event_type AS species_code,
               event_type AS swedish_name,
               CASE WHEN event_id % 2 = 0 THEN '2K' ELSE '1K' END AS age, value AS weight,
               50 + user_id % 40 AS wing_length, event_id % 12 AS fat_score,
               event_id % 4 AS muscle_score
        FROM events WHERE event_type IN ('click', 'purchase', 'signup')"""),
    "weather_a": ((), _weather_sql("view", "CASE WHEN count(*) > 1 THEN sum(value) END")),
    "weather_b": ((), _weather_sql("error", "sum(value)")),
    "weather_a_year": (("weather_a",), """
        SELECT * REPLACE (observation_time + to_days(CAST(day(observation_time) * 12 AS INTEGER)) AS observation_time)
        FROM weather_a"""),
    "weather_b_year": (("weather_b",), """
        SELECT * REPLACE (observation_time + to_days(CAST(day(observation_time) * 12 AS INTEGER)) AS observation_time)
        FROM weather_b"""),
    "captures_ev_year": (("captures_ev",), """
        SELECT * REPLACE (CAST(date + to_days(CAST(day(date) * 12 AS INTEGER)) AS DATE) AS date) FROM captures_ev"""),
    "weather_long": (("weather_a",), f"""
        SELECT *, 1 AS priority FROM ({_LONG})
        UNION ALL
        SELECT observation_time, parameter, value + 1, 2 FROM ({_LONG})
        WHERE extract(hour FROM observation_time) % 2 = 1"""),
    "observations": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS "OccurrenceId", o_orderdate AS "StartDate",
               o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) AS "EndDate",
               57.30 + CAST(o_custkey % 200 - 100 AS DOUBLE) / 1000 AS "DecimalLatitude",
               11.90 + CAST(o_orderkey % 200 - 100 AS DOUBLE) / 1000 AS "DecimalLongitude",
               CAST(o_custkey % 50 AS INTEGER) AS "DyntaxaTaxonId",
               CAST(o_orderkey % 3 AS INTEGER) AS "DataProviderId", o_totalprice AS price
        FROM orders"""),
    "taxonomy": (("observations",), """
        SELECT DISTINCT "DyntaxaTaxonId" AS taxon_id, "DyntaxaTaxonId" // 2 AS parent_id
        FROM observations"""),
}

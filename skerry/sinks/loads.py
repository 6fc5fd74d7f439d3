"""Loads into stored tables: only the partitions that a batch touches are read and rewritten.

A stored table is partitioned by month. A load first writes all new contents of the partitions it
touches to a table beside (staging), then the list of those partitions, which makes it certain, and
only then overwrites them. A load that fails before leaves the table as it was; one that fails after
is finished from the staged rows by the next load or by :func:`finish_load`, which may be repeated.

Loads into one table come one after the other; readers may meet the table between two partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.operators.joins import one_per_key
from skerry.schemas import OBSERVATIONS, WEATHER, add_missing, column, enforce_schema
from skerry.sinks.tables import swap_table, with_fetch_columns

#: The partition column, and what rows without a time have in it.
PART, UNDATED = "load_month", "undated"
#: Parts of a table's key index.
BUCKETS = 64


def month_of(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(UNDATED))


def _save(df: DataFrame, table: str, part: str) -> None:
    """A new table partitioned by one column, its partitions known to the catalog. One task writes a
    partition's file unless adaptive execution splits a large one."""
    df.repartition(part).write.partitionBy(part).saveAsTable(table)
    df.sparkSession.catalog.recoverPartitions(table)


def partitions(spark: SparkSession, table: str) -> list[str]:
    """The values of a table's one partition column, from the catalog."""
    return [r.partition.split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]


def create_stored(df: DataFrame, table: str, on: str, sort_by: Sequence[str] = ()) -> None:
    """Save rows as a new table partitioned by the month of ``on``, ordered in its files by ``on``
    and ``sort_by``, so that statistics in the files let a filter skip row groups."""
    months = df.withColumn(PART, month_of(column(on))).repartition(PART)
    months.sortWithinPartitions(PART, column(on), *[column(c) for c in sort_by]).write.partitionBy(PART).saveAsTable(table)
    df.sparkSession.catalog.recoverPartitions(table)


def read_stored(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop(PART)


def _overwrite(df: DataFrame, table: str) -> None:
    """Overwrite the partitions that ``df`` has rows for. An insert takes the mode from the session."""
    conf, mode = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(mode)
    conf.set(mode, "dynamic")
    try:
        df.write.mode("overwrite").insertInto(table)
    finally:
        conf.set(mode, before)


def finish_load(spark: SparkSession, table: str, part: str = PART) -> bool:
    """Apply a load that was staged whole, or drop one that was not. True if one was applied."""
    staged, touched = f"{table}__staged", f"{table}__touched"
    certain = spark.catalog.tableExists(touched)
    if certain:
        _overwrite(spark.table(staged).select(*[column(c) for c in spark.table(table).columns]), table)
        left = set(partitions(spark, staged))
        for value in (r[0] for r in spark.table(touched).collect()):
            if value not in left:
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({part} = '{value}')")
        spark.catalog.refreshTable(table)
        spark.sql(f"DROP TABLE {touched}")
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    return certain


def replace_touched(contents: DataFrame, table: str, touched: Sequence[str], part: str = PART) -> None:
    """Make ``contents``, which may read the table, the whole contents of the partitions ``touched``.
    One that has no rows any more goes; others are neither read nor written."""
    spark = contents.sparkSession
    finish_load(spark, table, part)
    _save(contents.select(*[column(c) for c in spark.table(table).columns]), f"{table}__staged", part)
    spark.createDataFrame([(v,) for v in sorted(touched)], f"`{part}` string").coalesce(1).write.saveAsTable(f"{table}__touched")
    finish_load(spark, table, part)


def replace_window_stored(batch: DataFrame, table: str, on: str = "observation_time") -> None:
    """``sinks.merge.replace_window`` for a stored table: every row between the batch's first and
    last time goes, then the batch comes in. Months between are replaced unread, those at the two
    ends rewritten with their rows outside the window; an empty batch changes nothing."""
    spark = batch.sparkSession
    finish_load(spark, table)
    time = column(on)
    span = batch.agg(F.min(time).alias("first"), F.max(time).alias("last"),
                     F.min(month_of(time)).alias("from"), F.max(F.when(time.isNotNull(), month_of(time))).alias("to")).first()
    if span["first"] is None:
        return
    touched = {p for p in partitions(spark, table) if span["from"] <= p <= span["to"]} | {span["from"], span["to"]}
    edges = spark.table(table).where(
        F.col(PART).isin(span["from"], span["to"]) & ((time < F.lit(span["first"])) | (time > F.lit(span["last"]))))
    timed = batch.where(time.isNotNull()).withColumn(PART, month_of(time))
    replace_touched(edges.unionByName(timed, allowMissingColumns=True), table, sorted(touched))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(column(key)), F.lit(BUCKETS)).cast("string").alias("bucket")


def _index(spark: SparkSession, table: str, key: str) -> str:
    """The table of (key, partition) beside a stored table, made from it if absent."""
    index = f"{table}__keys"
    if not spark.catalog.tableExists(index):
        _save(spark.table(table).select(column(key), PART, _bucket(key)), index, "bucket")
    return index


def upsert_stored(
    batch: DataFrame, table: str, key: str = "OccurrenceId", on: str = "StartDate", order: Sequence[Column] = (),
) -> None:
    """``sinks.merge.upsert`` for a stored table: rows of the batch replace those of their key.

    An index beside the table says in which month a key's row is, so that only months with an old
    row of the batch's keys or a new one are read and rewritten, a row that moves to another month
    included. New entries join the index before the table changes and old ones leave it after, so
    whatever fails, the index names too many months for a key at worst."""
    spark = batch.sparkSession
    finish_load(spark, table)
    index = _index(spark, table, key)
    finish_load(spark, index, "bucket")
    names = spark.table(table).columns
    fresh = one_per_key(batch, key, order).where(column(key).isNotNull())
    fresh = fresh.select(*[column(c) for c in fresh.columns if c in names and c != PART]).withColumn(PART, month_of(column(on)))
    spark.sql(f"DROP TABLE IF EXISTS {table}__batch")
    fresh.write.saveAsTable(f"{table}__batch")  # used several times below
    fresh = spark.table(f"{table}__batch")
    keys = fresh.select(column(key), PART, _bucket(key))
    buckets = [r[0] for r in keys.select("bucket").distinct().collect()]  # BUCKETS at most
    known = spark.table(index).where(F.col("bucket").isin(buckets))
    before = known.join(keys.select(column(key)), key, "left_semi").select(PART)
    touched = [r[0] for r in before.unionByName(keys.select(PART)).distinct().collect()]  # one for a month
    if touched:
        keys.select(*spark.table(index).columns).write.insertInto(index)
        kept = spark.table(table).where(F.col(PART).isin(touched)).join(keys.select(column(key)), key, "left_anti")
        replace_touched(kept.unionByName(fresh, allowMissingColumns=True), table, touched)
        rest = spark.table(index).where(F.col("bucket").isin(buckets)).join(keys.select(column(key)), key, "left_anti")
        replace_touched(rest.unionByName(keys), index, buckets, "bucket")
    spark.sql(f"DROP TABLE {table}__batch")


def evolve_stored(spark: SparkSession, table: str, schema: T.StructType, key: str, on: str) -> list[str]:
    """Make a stored table fit its declared schema and say what was done.

    An absent table is created. One without its key column is from before it had one: its rows
    cannot be told apart, and it is replaced by an empty one, written beside it first. Other
    columns that are absent are added in the catalog; no file is rewritten, old rows read as null."""
    empty = spark.createDataFrame([], schema)
    if not spark.catalog.tableExists(table):
        create_stored(empty, table, on)
        return ["created"]
    have = spark.table(table).columns
    if key not in have or PART not in have:
        swap_table(empty.withColumn(PART, month_of(column(on))), table, [PART])
        return ["rebuilt"]
    missing = [f for f in schema if f.name not in have]
    if missing:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in missing)})")
    return [f"added {f.name}" for f in missing]


def load_weather(batch: DataFrame, table: str, **constants: object) -> None:
    """Fetched hourly weather into its table: schema first, then the batch's window replaced.
    ``constants`` are the station's, such as ``station_id`` and ``data_source``."""
    evolve_stored(batch.sparkSession, table, WEATHER, "observation_time", "observation_time")
    replace_window_stored(enforce_schema(with_fetch_columns(batch, **constants), WEATHER), table)


def load_observations(batch: DataFrame, table: str, order: Sequence[Column] = ()) -> None:
    """Fetched observations into their table: schema first, then an upsert by OccurrenceId."""
    evolve_stored(batch.sparkSession, table, OBSERVATIONS, "OccurrenceId", "StartDate")
    declared = with_fetch_columns(add_missing(batch, OBSERVATIONS))
    upsert_stored(declared, table, order=order)

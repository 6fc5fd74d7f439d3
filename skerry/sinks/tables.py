"""Writing tables and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.schemas import column
from skerry.session import checkpointed

SAVE_MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}
STATISTICS = "ANALYZE TABLE {} COMPUTE STATISTICS FOR ALL COLUMNS"


def save_table(
    df: DataFrame, table: str, if_exists: str = "append", partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """Save as a catalog table: ``append``, ``replace`` or ``fail`` when it exists.

    ``sort_by`` orders rows inside each file, so that Parquet statistics let a filter skip row
    groups; it stands in for secondary indexes."""
    if if_exists not in SAVE_MODES:
        raise ValueError(f"if_exists is one of {sorted(SAVE_MODES)}")
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(SAVE_MODES[if_exists])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def refresh_statistics(spark: SparkSession, table: str) -> None:
    spark.sql(STATISTICS.format(table))


def swap_table(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table with a DataFrame that may read it: write beside it, then rename."""
    spark = df.sparkSession
    staged = f"{table}__next"
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    save_table(df, staged, "fail", partition_by)
    before = f"{table}__before"
    spark.sql(f"DROP TABLE IF EXISTS {before}")
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {before}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {before}")


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions ``df`` has rows for. With a table partitioned by month, a
    window replace or an upsert of recent data rewrites those months and nothing else."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by).parquet(path)


def export_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_formats(
    df: DataFrame, base: str, formats: Sequence[str] = ("parquet", "csv"), mode: str = "overwrite"
) -> None:
    """One folder ``<base>.<format>`` per format: parquet, csv (with header) or json (lines)."""
    unknown = set(formats) - {"parquet", "csv", "json"}
    if unknown:
        raise ValueError(f"cannot export {sorted(unknown)}")
    for name in formats:
        export_csv(df, f"{base}.csv", mode) if name == "csv" else df.write.mode(mode).format(
            name).save(f"{base}.{name}")


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def with_audit_columns(df: DataFrame, **constants: object) -> DataFrame:
    """Add constants such as ``data_source`` or ``station_id``, and the load time."""
    now = F.current_timestamp().cast("timestamp_ntz")
    stamps = {name: now for name in ("created_at", "updated_at")}
    return df.withColumns({**{k: F.lit(v) for k, v in constants.items()}, **stamps})


def with_fetch_columns(df: DataFrame, **constants: object) -> DataFrame:
    """As :func:`with_audit_columns` for fetched data, which carries one ``fetched_at``."""
    now = F.current_timestamp().cast("timestamp_ntz")
    return df.withColumns({**{k: F.lit(v) for k, v in constants.items()}, "fetched_at": now})


def with_record_ids(df: DataFrame, after: int = 0, name: str = "record_id") -> DataFrame:
    """Number the rows ``after + 1, after + 2, …`` without gaps and without sorting them.

    Rows are pinned down by a checkpoint, so a retried task numbers the same rows again. A row's
    id is its position in its partition plus the rows of the partitions before it; the table of
    partition sizes has one row per partition, which bounds both its window and its broadcast."""
    fixed = checkpointed(df)
    position = F.monotonically_increasing_id()
    placed = fixed.withColumns({
        "_part": F.shiftright(position, 33), "_index": position.bitwiseAND(F.lit((1 << 33) - 1)),
    })
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_index") + F.lit(after + 1))
    rest = [column(c) for c in df.columns if c != name]
    return numbered.select(column(name), *rest)


def load_captures(
    df: DataFrame, table: str, if_exists: str = "append", data_source: str = "CSV"
) -> None:
    """Number, stamp and save captures that already conform to the schema."""
    spark = df.sparkSession
    after = 0
    if if_exists == "append" and spark.catalog.tableExists(table):
        after = spark.table(table).agg(F.max("record_id")).first()[0] or 0
    numbered = with_record_ids(with_audit_columns(df, data_source=data_source), after)
    save_table(numbered, table, if_exists, sort_by=["species_code", "date"])

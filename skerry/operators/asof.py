"""As-of join: each left row meets the latest right row at or before its timestamp.

The right side is turned into *validity intervals* cut at the borders of fixed time buckets. An
interval runs from one right row to the next; a bucket in which left rows fall starts with one
interval carrying the last earlier row. Buckets without left rows get none, however long the time
between two right rows. Within a bucket the intervals do not overlap, so the join
is an equality on the bucket with a range check, and every left row meets at most one interval.

What that means for size: the left rows are scanned once and neither aggregated nor windowed; a
second scan of their timestamps alone finds their buckets. Where Spark's estimate of the intervals is below the broadcast bound the left side is not shuffled
either; above it both sides are shuffled by bucket, and adaptive execution splits a bucket that
holds too many left rows. Only right rows are windowed, within their bucket, and the numbers of
buckets, within blocks of ``BLOCK`` and once over one number per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.dates import epoch_micros
from skerry.schemas import column

HOUR = 3600
#: Bucket numbers that are ordered in one go.
BLOCK = 4096


def _bucket(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")


def validity_intervals(
    right: DataFrame, on: str, asked: DataFrame, bucket_seconds: int = HOUR
) -> DataFrame:
    """Columns ``_bucket``, ``_from``, ``_until`` (exclusive; microseconds) and ``_row``, the
    right row in force, for all of each ``_bucket`` of ``asked`` (distinct)."""
    size = bucket_seconds * 1_000_000
    # One row per timestamp. Copies collapse map-side; of different rows the greatest wins.
    own = (
        right.where(column(on).isNotNull())
        .groupBy(column(on).alias("_ts"))
        .agg(F.max(F.struct(*[column(name) for name in right.columns])).alias("_row"))
        .select(epoch_micros(F.col("_ts")).alias("_from"), "_row")
        .select(_bucket(F.col("_from"), bucket_seconds).alias("_bucket"), "_from", "_row",
                F.lit(1).alias("_own"))
    )
    latest = own.groupBy("_bucket").agg(F.max_by("_row", "_from").alias("_row"))
    # In a bucket that is asked for, the last row of the occupied bucket before it stays in force.
    carried = (
        _occupied_before(asked, latest.select("_bucket"))
        .join(latest.withColumnRenamed("_bucket", "_earlier"), "_earlier")
        .select("_bucket", (F.col("_bucket") * size).alias("_from"), "_row", F.lit(0).alias("_own"))
    )
    # At an equal start the bucket's own row sorts last and leaves the carried one no time.
    within = Window.partitionBy("_bucket").orderBy("_from", "_own")
    until = F.coalesce(F.lead("_from").over(within), (F.col("_bucket") + 1) * size)
    return (
        own.unionByName(carried)
        .withColumn("_until", until)
        .where(F.col("_from") < F.col("_until"))
        .select("_bucket", "_from", "_until", "_row")
    )


def _occupied_before(asked: DataFrame, occupied: DataFrame) -> DataFrame:
    """``_bucket`` of ``asked`` (distinct) with ``_earlier``, the last of ``occupied`` before it;
    those without one are left out.

    Buckets are ordered within blocks of them; what comes before a block is the greatest occupied
    bucket of the blocks before it."""
    steps = asked.select("_bucket", F.lit(None).cast("bigint").alias("_has"), F.lit(True).alias("_asked")).unionByName(
        occupied.select("_bucket", F.col("_bucket").alias("_has"), F.lit(False).alias("_asked")))
    steps = steps.groupBy("_bucket").agg(F.max("_has").alias("_has"), F.max("_asked").alias("_asked")).withColumn(
        "_block", F.floor(F.col("_bucket") / F.lit(BLOCK)).cast("bigint"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy("_block").agg(F.max("_has").alias("_most")).select(
        "_block", F.max("_most").over(before).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        steps.withColumn("_inside", F.max("_has").over(inside)).where("_asked").join(blocks, "_block")
        .select("_bucket", F.coalesce("_inside", "_before").alias("_earlier"))
        .where(F.col("_earlier").isNotNull())
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "inner",
    gap: str | None = None,
    bucket_seconds: int = HOUR,
) -> DataFrame:
    """Left columns, then right columns (names must differ), then ``gap``: the age of the match
    in hours, where asked for. ``how`` is ``inner`` (unmatched and null timestamps are dropped)
    or ``left``.

    Choose ``bucket_seconds`` so that a bucket holds few right rows; an hour suits readings that
    come every few minutes or slower.
    """
    if how not in ("inner", "left"):
        raise ValueError("an as-of join is inner or left")
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}")
    at = _bucket(epoch_micros(column(left_on)), bucket_seconds)
    asked = left.where(column(left_on).isNotNull()).select(at.alias("_bucket")).distinct()
    intervals = validity_intervals(right, right_on, asked, bucket_seconds)
    moment = left.withColumn("_at", epoch_micros(column(left_on)))
    keyed = moment.withColumn("_in", _bucket(F.col("_at"), bucket_seconds))
    # The intervals are already placed by bucket. A second key asks for a shuffle made for the join,
    # without which adaptive execution would not split a hot bucket (see joins.skew_safe_join).
    joined = keyed.withColumn("_left_slot", F.xxhash64("_in")).join(
        intervals.withColumn("_slot", F.xxhash64("_bucket")),
        (F.col("_left_slot") == F.col("_slot")) & (F.col("_in") == F.col("_bucket"))
        & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_until")),
        how,
    )
    matched = [F.col("_row").getField(name).alias(name) for name in right.columns]
    result = joined.select(*[column(name) for name in left.columns], *matched, "_at")
    if gap:
        age = (F.col("_at") - epoch_micros(column(right_on))) / F.lit(3_600_000_000.0)
        result = result.withColumn(gap, age)
    return result.drop("_at")

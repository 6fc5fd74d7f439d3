"""Table changes as DataFrames: the table after the change, from the table before and a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.joins import one_per_key
from skerry.schemas import column


def replace_window(
    target: DataFrame, batch: DataFrame, on: str = "observation_time"
) -> DataFrame:
    """Every target row between the batch's first and last timestamp goes, then the batch comes
    in. Rows inside the window that the batch does not mention go too; an empty batch changes
    nothing. The bounds are a scalar subquery, so the target is only filtered."""
    span = batch.agg(F.struct(
        F.min(column(on)).alias("first"), F.max(column(on)).alias("last")).alias("span")).scalar()
    inside = F.coalesce(column(on).between(span["first"], span["last"]), F.lit(False))
    return target.where(~inside).unionByName(batch, allowMissingColumns=True)


def without_keys(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target rows whose key the batch does not have."""
    return target.join(batch.select(column(key)), key, "left_anti").select(
        *[column(c) for c in target.columns])


def upsert(
    target: DataFrame, batch: DataFrame, key: str = "OccurrenceId", order: Sequence[Column] = ()
) -> DataFrame:
    """Replace by key. The batch is reduced to one row per key first (greatest by ``order``) and
    to the columns the target has; columns it lacks become null."""
    shared = [c for c in batch.columns if c in set(target.columns)]
    fresh = one_per_key(batch, key, order).select(*[column(c) for c in shared])
    return without_keys(target, fresh, key).unionByName(fresh, allowMissingColumns=True)

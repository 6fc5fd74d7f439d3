"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window group holds on average.
GROUP_ROWS = 2_000


def interleaved(docs: DataFrame, shards: int = 16, seed: int = 42, source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard and slot of every row of (doc_id, text, source).

    Rows are ranked within their source in the order of a seeded digest of doc_id, all rows are
    sorted by (rank - 1/2) / rows of the source, then source, and the order is cut into `shards`
    runs of which the sizes differ by one at most; so each run has its share of every source. `slot`
    is the place within the run.

    Null sources are a source of their own; a null text has size 1 and the checksum of no bytes;
    rows of equal doc_id and source are adjacent in rank, ordered by checksum; an empty table gives
    no rows; other columns are left out.

    No source meets in one task: the digests are cut into equal ranges, so that a range of a source
    has about GROUP_ROWS rows; a rank is the rows of the ranges before, from a small table of
    counts, plus the row's place in its range. The global order is cut in the same way. Only
    numbers are shuffled, no texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"), digest.alias("digest"))
    ranges = max(1, docs.count() // GROUP_ROWS)
    share = F.conv(F.substring("digest", 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    rows = rows.withColumn("range", F.floor(share * ranges).cast("int"))

    counts = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.sum("n").over(Window.partitionBy("source")).alias("of_source"))
    within = Window.partitionBy("source", "range").orderBy("digest", "doc_id", "text_crc32", "size")
    placed = rows.join(counts, ["source", "range"]).withColumn("rank", F.col("before") + F.row_number().over(within))
    fraction = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("of_source"))
    placed = placed.select("doc_id", "size", "text_crc32", "source", "rank", fraction.alias("fraction"),
                           F.least(F.floor(fraction * ranges), F.lit(ranges - 1)).cast("int").alias("range"))

    totals = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.sum("n").over(Window.partitionBy()).alias("all"))
    order = Window.partitionBy("range").orderBy("fraction", "source", "rank")
    position = F.col("before") + F.row_number().over(order) - 1
    return (placed.join(totals, "range").withColumn("position", position)
            .withColumn("shard", _shard(F.col("position"), F.col("all"), shards))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("position") - _first(F.col("shard"), F.col("all"), shards)).alias("slot")))


def _shard(position: Column, rows: Column, shards: int) -> Column:
    """The run of a position: the first rows % shards runs have one row more."""
    size, longer = F.floor(rows / shards), rows % shards
    return F.when(position < longer * (size + 1), F.floor(position / (size + 1))).otherwise(
        longer + F.floor((position - longer * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")


def _first(shard: Column, rows: Column, shards: int) -> Column:
    """The first position of a run."""
    return shard * F.floor(rows / shards) + F.least(shard, rows % shards)

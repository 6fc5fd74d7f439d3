"""Connected components of links, as label propagation on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.text import stored


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in edges (a, b), both long.

    Alternating large-star and small-star steps: every id hangs the larger of its neighbours, then
    the smaller ones, on the smallest. The steps end when nothing changes, after about as many as
    the logarithm of the longest path; each is written to the shared folder, and a smallest
    neighbour is an aggregate, so that no id's neighbours meet in one task's memory."""
    rows = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        small = stored(small, "links")
        same = rows.unionByName(small).groupBy("u", "v").count().where("count = 1").isEmpty()
        rows = small
        if same:
            break
    stars = rows.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())

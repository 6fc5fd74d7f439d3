"""URL rules by host suffix and path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.joins import skew_safe_join


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1), r"(?s)^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1), r"(?s)^[^?#]*", 0)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    rules: host, path, verdict. A rule fits its host and the host's subdomains, if the path begins
    with the rule's. The longest host and path together wins, then the longer host. Of equal rules
    the lesser verdict counts. Rules with a null in a column are left out. Without a rule
    that fits, `rule` is null and the verdict is `default`.

    Every distinct host and path is expanded into the pairs of a host suffix and a path prefix, of
    the numbers of labels and the lengths of prefix that rules have; only these, bounded by the
    longest host and path of a rule, go to the driver. The pairs meet the rules by the first 8 digits of a digest, and the whole
    digest is compared. A column of the result that `pages` has already is replaced; rows of pages
    are kept as they are, repeated ones too; null urls have an empty host and path and fit nothing.
    """
    key = lambda host, path: F.sha2(F.concat_ws("\n", host, path), 256)
    known = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
             .groupBy(F.lower("host").alias("host"), "path").agg(F.min("verdict").alias("verdict")))
    shapes = known.select(F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels")).distinct().collect()
    lengths, label_counts = sorted({r["n"] for r in shapes}), sorted({r["labels"] for r in shapes})
    known = known.select(
        F.substring(key(F.col("host"), F.col("path")), 1, 8).alias("short"), key(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"))
    pages = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    labels = F.split("host", r"\.")
    whole = F.filter(F.array(*[F.lit(n) for n in label_counts]).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(whole, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    pairs = (pages.where("host <> ''").select("host", "path").distinct()
             .select("host", "path", F.explode(suffixes).alias("suffix"))
             .select("host", "path", "suffix", F.explode(fitting).alias("n"))
             .select("host", "path", key(F.col("suffix"), F.expr("substring(path, 1, n)")).alias("digest"))
             .withColumn("short", F.substring("digest", 1, 8)))
    name = "_best"
    while name in pages.columns:
        name += "_"
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("host_length"), F.col("verdict") == "block"))
    met = (pairs.join(known.withColumnRenamed("digest", "whole"), "short").where("digest = whole")
           .groupBy("host", "path").agg(best.alias(name)))
    judged = skew_safe_join(pages, met, ["host", "path"], "left")
    return (judged.withColumn("rule", F.col(f"{name}.rule"))
            .withColumn("verdict", F.coalesce(f"{name}.verdict", F.lit(default))).drop(name))

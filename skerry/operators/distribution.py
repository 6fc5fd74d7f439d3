"""Exact quantiles, box statistics and outlier flags that no single task has to hold.

``percentile`` keeps one group's distinct values in one task's memory, which is fine for a
bounded domain such as the day of the year and wrong for a measurement of a group that owns a
third of the data. Here values are first counted, so copies collapse map-side. A sample of a
group's distinct values, taken by hash and so the same in every retry, cuts them into *slices* of
about 1/256 of the distinct values each, however they are placed. Totals of the slices tell in
which of them a rank falls; only the values of those slices are sorted. So ranks come out exact,
and most values are neither shuffled a second time nor sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.joins import skew_safe_join
from skerry.schemas import column

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}

#: Distinct values of a group that are sampled at most; each 16th of them ends a slice, and the
#: slices are looked up by 16 at a time.
_SAMPLES = 4096
_STEP = 16


def _ranks(method: str, p: float, n: Column) -> list[Column]:
    """1-based ranks a quantile reads; two of them where it interpolates."""
    if method == "disc":
        return [F.greatest(F.ceil(n * F.lit(p)), F.lit(1))]
    position = (n - 1) * F.lit(p)
    if method == "nearest":
        return [F.floor(position + 0.5) + 1]
    if method == "linear":
        return [F.floor(position) + 1, F.ceil(position) + 1]
    raise ValueError(f"unknown quantile method {method!r}")


def value_counts(
    df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Non-null values per group with their counts: columns ``_g``, ``_v``, ``_c``. A row counts
    once, or ``weight`` times where rows are counts already.

    ``_g`` holds the keys as one struct. A struct is never null and null fields compare equal, so
    later steps join and partition by it without extra null handling or an extra shuffle."""
    group = F.struct(*[column(k).alias(k) for k in keys], F.lit(0).alias("_all"))
    times = column(weight) if weight else F.lit(1)
    measured = df.select(
        group.alias("_g"), column(value).cast("double").alias("_v"), times.alias("_times"))
    return measured.where(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(
        F.sum("_times").cast("bigint").alias("_c")
    )


def _keys_of(keys: Sequence[str]) -> list[Column]:
    return [F.col("_g").getField(k).alias(k) for k in keys]


def distribution(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    quantiles: Mapping[str, float] = QUARTILES,
    method: str = "disc",
    bounded: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Per group: ``n``, ``mean``, ``std`` (sample), ``min``, ``max`` and the named quantiles.

    ``method`` is ``disc`` (smallest value whose share reaches p), ``nearest`` (element at
    floor((n-1)p + 0.5)) or ``linear``; a mapping value may also be a ``(p, method)`` pair.
    ``bounded`` says that a group cannot have many distinct values (days of the year, one value
    per calendar day): its counts are then ranked in one go, without slices.
    """
    per_group = _group_stats(
        value_counts(df, value, keys) if counts is None else counts, quantiles, method, bounded)
    named = [name for name in per_group.columns if name != "_g"]
    return per_group.select(*_keys_of(keys), *named)


def _group_stats(
    counts: DataFrame, quantiles: Mapping[str, object], method: str, bounded: bool
) -> DataFrame:
    """The statistics of :func:`distribution` per ``_g``."""
    n, v, c = F.col("_n"), F.col("_v"), F.col("_c")
    specs = {name: spec if isinstance(spec, tuple) else (spec, method) for name, spec in quantiles.items()}
    ranks = [rank for p, how in specs.values() for rank in _ranks(how, p, n)]
    ranked = _ranked_whole(counts) if bounded else _ranked_by_slice(counts, ranks)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - c < rank), v))

    picks = {}
    for name, (p, how) in specs.items():
        found = [at(rank) for rank in _ranks(how, p, n)]
        if len(found) == 1:
            picks[name] = found[0]
        else:
            share = F.max((n - 1) * F.lit(p) - F.floor((n - 1) * F.lit(p)))
            picks[name] = found[0] + (found[1] - found[0]) * share
    size = F.max("_n")
    if bounded:
        squares, low, high = F.sum(c * (v - F.col("_mean")) * (v - F.col("_mean"))), F.min("_v"), F.max("_v")
    else:
        squares, low, high = F.max("_squares"), F.max("_low"), F.max("_high")
    return ranked.groupBy("_g").agg(
        size.alias("n"),
        F.max("_mean").alias("mean"),
        F.when(size > 1, F.sqrt(squares / (size - 1))).alias("std"),
        low.alias("min"),
        *[picked.alias(name) for name, picked in picks.items()],
        high.alias("max"),
    )


def _ranked_whole(counts: DataFrame) -> DataFrame:
    """Counts with ``_n``, ``_mean`` and ``_upto``, the rank of a value's last copy."""
    group = Window.partitionBy("_g")
    total = F.sum("_c").over(group)
    return counts.select(
        "_g", "_v", "_c", total.alias("_n"),
        (F.sum(F.col("_v") * F.col("_c")).over(group) / total).alias("_mean"),
        F.sum("_c").over(group.orderBy("_v")).alias("_upto"),
    )


def _edges(counts: DataFrame) -> DataFrame:
    """Per ``_g``: ``_edges``, the sorted values that end a slice, 256 at most, and ``_middle``, a value
    of the sample's middle. Of each of 4,096 hash buckets the distinct value of the smallest hash
    is in the sample, so that it is spread evenly over the distinct values."""
    place = F.xxhash64("_v")
    # NaN sorts behind all numbers: it lies in the last slice and ends none.
    sample = counts.where(~F.isnan("_v")).groupBy(
        "_g", F.pmod(place, F.lit(_SAMPLES)).alias("_bucket")).agg(F.min_by("_v", place).alias("_v"))
    values = sample.groupBy("_g").agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    return values.select(
        "_g", F.filter("_values", lambda _, i: i % _STEP == _STEP - 1).alias("_edges"),
        F.get("_values", F.floor(F.size("_values") / 2).cast("int")).alias("_middle"))


def _sliced(counts: DataFrame) -> DataFrame:
    """Counts with their slice, ``_s`` and ``_t``, and the group's ``_middle``. Slices are in the
    order of the values, by the first number, then the second."""
    placed = skew_safe_join(counts, _edges(counts), ["_g"], "left")

    def below(places: Sequence[Column]) -> Column:
        """How many of the edges at ``places`` are smaller; plain comparisons, which are compiled."""
        return sum((F.when(F.get("_edges", i) < F.col("_v"), 1).otherwise(0) for i in places), F.lit(0))

    return placed.withColumn("_s", below([F.lit(_STEP * i + _STEP - 1) for i in range(_STEP)])).select(
        "_g", "_v", "_c", "_s", below([F.col("_s") * _STEP + i for i in range(_STEP)]).alias("_t"),
        F.coalesce("_middle", F.lit(0.0)).alias("_middle"))


def _ranked_by_slice(counts: DataFrame, ranks: Sequence[Column]) -> DataFrame:
    """As :func:`_ranked_whole`, but only the values of slices in which one of ``ranks`` falls, each
    with its group's ``_n``, ``_mean``, ``_squares`` (of distances from the mean), ``_low`` and ``_high``."""
    hist = _sliced(counts)
    own = ["_g", "_s", "_t"]
    away = F.col("_v") - F.col("_middle")
    slices = hist.groupBy(*own).agg(
        F.sum("_c").alias("_in"), F.sum(F.col("_v") * F.col("_c")).alias("_total"),
        F.sum(away * F.col("_c")).alias("_away"), F.sum(away * away * F.col("_c")).alias("_away2"),
        F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    # A group has 257 slices at most. Squares are summed around a middle value, which keeps digits.
    group = Window.partitionBy("_g")
    before = group.orderBy("_s", "_t").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("_in").over(group)
    away_all = F.sum("_away").over(group)
    slices = slices.select(
        *own, "_in", "_least", "_most", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_below"), size.alias("_n"),
        (F.sum("_total").over(group) / size).alias("_mean"),
        F.greatest(F.sum("_away2").over(group) - away_all * away_all / size, F.lit(0.0)).alias("_squares"),
        F.min("_least").over(group).alias("_low"), F.max("_most").over(group).alias("_high"))
    falls = [(rank > F.col("_below")) & (rank <= F.col("_below") + F.col("_in")) for rank in ranks]
    wanted = slices.where(F.exists(F.array(*falls), lambda here: here)).drop("_in")
    # A group has few such slices: their bounds pick the values, which are not placed again.
    chosen = skew_safe_join(counts, wanted, ["_g"]).where(F.col("_v").between(F.col("_least"), F.col("_most")))
    within = Window.partitionBy(*own).orderBy("_v")
    return chosen.drop("_least", "_most").withColumn("_upto", F.col("_below") + F.sum("_c").over(within))


def box_stats(
    df: DataFrame, value: str, keys: Sequence[str] = (), fence: float = 1.5,
    bounded: bool = False, weight: str | None = None,
) -> DataFrame:
    """What a box plot draws: quartiles (linear), the whiskers (outermost values within
    ``fence`` x IQR of the box) and how many rows lie beyond them."""
    counts = value_counts(df, value, keys, weight)
    stats = _group_stats(counts, QUARTILES, "linear", bounded)
    reach = (F.col("q75") - F.col("q25")) * fence
    inside = F.col("_v").between(F.col("q25") - reach, F.col("q75") + reach)
    described = [name for name in stats.columns if name != "_g"]
    boxes = skew_safe_join(counts, stats, ["_g"]).groupBy("_g").agg(
        *[F.max(name).alias(name) for name in described],
        F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("n_outliers"),
    )
    return boxes.select(
        *_keys_of(keys), *described, "lower_whisker", "upper_whisker", "n_outliers")


def flag_outliers(
    df: DataFrame, value: str, method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Add ``<value>_outlier``: outside the whole column's quartile fences, or more than
    ``threshold`` standard deviations from its mean. Null values get a null flag.

    The bounds are scalar subqueries, so the rows themselves are never shuffled.
    """
    name = f"{value}_outlier"
    measured = column(value)
    if method == "iqr":
        stats = distribution(df, value, (), {"q1": 0.25, "q3": 0.75}, "nearest")
        reach = (F.col("q3") - F.col("q1")) * threshold
        bounds = stats.select(F.struct(
            (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
        ).alias("bounds")).scalar()
        return df.withColumn(name, (measured < bounds["low"]) | (measured > bounds["high"]))
    if method == "zscore":
        usual = df.agg(F.struct(
            F.avg(measured).alias("mean"), F.stddev_samp(measured).alias("spread")
        ).alias("usual")).scalar()
        distance = F.abs(measured - usual["mean"]) / F.nullif(usual["spread"], F.lit(0.0))
        return df.withColumn(name, distance > threshold)
    raise ValueError(f"unknown outlier method {method!r}")

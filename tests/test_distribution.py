import random

import numpy as np
import pytest

from skerry.operators.distribution import (
    _sliced, box_stats, distribution, flag_outliers, value_counts,
)


@pytest.mark.parametrize("bounded", [False, True])
def test_equals_numpy_with_a_hot_and_a_null_group(spark, bounded):
    rng = random.Random(5)
    data = [("hot", round(rng.lognormvariate(2, 1.5), 1)) for _ in range(3000)]
    data += [("neg", round(rng.uniform(-50, 50), 2)) for _ in range(400)]
    data += [(None, v) for v in (4.0, 4.0, 9.0)] + [("one", 7.0), ("one", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    quantiles = {
        "d1": (0.1, "disc"), "d5": (0.5, "disc"), "l25": (0.25, "linear"),
        "l9": (0.9, "linear"), "n75": (0.75, "nearest"),
    }
    found = {r.k: r for r in distribution(df, "v", ["k"], quantiles, bounded=bounded).collect()}
    assert set(found) == {"hot", "neg", None, "one"}
    for key, row in found.items():
        values = np.sort([v for k, v in data if k == key and v is not None])
        n = len(values)
        assert row.n == n and row["min"] == values[0] and row["max"] == values[-1]
        assert row["mean"] == pytest.approx(values.mean())
        assert row["std"] == (None if n == 1 else pytest.approx(values.std(ddof=1)))
        assert row.d1 == values[max(int(np.ceil(0.1 * n)), 1) - 1]
        assert row.d5 == values[int(np.ceil(0.5 * n)) - 1]
        assert row.l25 == pytest.approx(np.quantile(values, 0.25))
        assert row.l9 == pytest.approx(np.quantile(values, 0.9))
        assert row.n75 == values[int((n - 1) * 0.75 + 0.5)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert distribution(df, "v", ["k"]).isEmpty()


def test_box_stats_whiskers(spark):
    df = spark.createDataFrame(
        [("a", float(v)) for v in (1, 2, 3, 4, 5, 100)], "k string, v double")
    row = box_stats(df, "v", ["k"]).first()
    assert (row.lower_whisker, row.upper_whisker, row.n_outliers) == (1.0, 5.0, 1)
    assert box_stats(df, "v").first().n_outliers == 1


def test_outlier_flags(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(500.0,), (None,)], "v double")
    iqr = {r.v: r.v_outlier for r in flag_outliers(df, "v").collect()}
    assert iqr[500.0] is True and iqr[3.0] is False and iqr[None] is None
    z = {r.v: r.v_outlier for r in flag_outliers(df, "v", "zscore", 3).collect()}
    assert z[500.0] is True and z[0.0] is False
    with pytest.raises(ValueError):
        flag_outliers(df, "v", "other")


def test_constant_column_has_no_zscore_outliers(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v_outlier for r in flag_outliers(df, "v", "zscore").collect()] == [None, None]


def test_tightly_placed_values_are_spread_over_slices(spark):
    values = [57.30 + i * 5e-6 for i in range(10_000)] + [0.0, 1e9, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = _sliced(value_counts(df, "v")).groupBy("_s", "_t").count()
    assert max(r["count"] for r in shares.collect()) < 500
    row = distribution(df, "v", (), {"median": (0.5, "disc"), "top": (1.0, "disc")}).first()
    assert row["median"] == sorted(values[:-2] + [2e9, 3e9])[5001] and np.isnan(row["top"])


def test_a_stray_value_beside_tightly_placed_ones(spark):
    """99.9 % of the distinct values lie in a thousandth of the span of 57.30 to 57.31; a hot group of
    copies and a group of few values beside it."""
    values = [57.30 + i * 1e-9 for i in range(9_990)] + [57.31 + i * 1e-3 for i in range(10)]
    rows = [("tight", v) for v in values] + [("copies", 3.5)] * 5_000 + [("few", float(i)) for i in range(7)]
    rows += [("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = _sliced(value_counts(df, "v", ["k"])).groupBy("_g", "_s", "_t").count()
    assert max(r["count"] for r in shares.collect()) < 200
    quantiles = {f"p{i}": (i / 1000, "linear") for i in (1, 250, 500, 998, 1000)}
    found = {r.k: r for r in distribution(df, "v", ["k"], quantiles).collect()}
    for name, (p, _) in quantiles.items():
        assert found["tight"][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert found["few"][name] == pytest.approx(6 * p) and found["copies"][name] == 3.5
        assert np.isnan(found["nan"][name])
    assert found["tight"].std == pytest.approx(np.std(values, ddof=1), rel=1e-6)
    assert found["copies"].n == 5_000 and found["copies"].std == 0

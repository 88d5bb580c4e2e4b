"""Resamples with a fixed number of draws: exactly n in each, distributed as draws with replacement are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import stats


def test_every_resample_has_n_draws_and_their_spread(spark):
    n = 300
    rows = [("a", float(i), float(i % 7), 1) for i in range(n)] + [("b", 1.0, 2.0, 40), ("b", 2.0, 1.0, 60)] + [(None, 0.5, float(i), 1) for i in range(6)]
    pairs = spark.createDataFrame(rows, "g string, _x double, _y double, m long")
    got = stats.resample_moments(pairs, ["g"], 400, 3, leaf=16).toPandas()
    size = {"a": n, "b": 100, None: 6}
    for g, k in size.items():
        part = got[got["g"].isna()] if g is None else got[got["g"] == g]
        assert len(part) == 400 and (part["_w"] == k).all()
    a, b = got[got["g"] == "a"], got[got["g"] == "b"]
    # the mean of n draws from 0 .. n-1, its variance, and the number of draws of one of two values
    assert abs(a["_sx"].mean() / n - (n - 1) / 2) < 4 * np.sqrt((n * n - 1) / 12 / n / 400)
    assert a["_sx"].var() / n == pytest.approx((n * n - 1) / 12, rel=0.3)
    ones = 200 - b["_sx"]  # draws of 1.0
    assert abs(ones.mean() - 40) < 4 * np.sqrt(24 / 400) and ones.var() == pytest.approx(24, rel=0.3)
    again = stats.resample_moments(pairs.repartition(5), ["g"], 400, 3, leaf=16).toPandas()
    assert sorted(again["_sx"].round(6)) == sorted(got["_sx"].round(6))
    other = stats.resample_moments(pairs, ["g"], 400, 4, leaf=16).toPandas()
    assert sorted(other["_sx"].round(6)) != sorted(got["_sx"].round(6))


def test_intervals_agree_with_plain_resampling(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = 0.6 * x + rng.normal(size=200)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("few", 1.0, 2.0)] * 4 + [("flat", 1.0, float(i)) for i in range(9)] + [("g", float("nan"), 1.0)], "g string, x double, y double")
    got = {r.g: r for r in stats.bootstrap_exact(df, ["g"], "x", "y", 800, leaf=32).collect()}
    at = rng.integers(0, 200, (3000, 200))
    plain = [np.corrcoef(x[i], y[i])[0, 1] for i in at]
    assert got["g"].n == 200 and [got["g"].lo, got["g"].hi] == pytest.approx(np.percentile(plain, [2.5, 97.5]), abs=0.03)
    assert got["few"].lo is None and got["flat"].lo is None and got["few"].n == 4
    assert stats.bootstrap_exact(df.where(F.col("g") == "none"), ["g"], "x", "y", 50).collect() == []

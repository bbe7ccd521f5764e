"""Distributed transforms against NumPy's, and the growth of their work."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofmill.operators import correlation as P


def plain(x, y):
    """Circular correlation about the means of two dense arrays."""
    x, y = x - x.mean(), y - y.mean()
    return np.fft.ifftn(np.fft.fftn(x) * np.conj(np.fft.fftn(y))).real / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-12)


@pytest.mark.parametrize("length", [1, 2, 3, 30, 64, 97, 1000])
def test_series_of_any_length(spark, length):
    rng = np.random.default_rng(length)
    data = {k: (rng.normal(size=length), rng.normal(size=length)) for k in ("a", "b", None)}
    side = lambda i: spark.createDataFrame([(k, t, float(v[i][t])) for k, v in data.items() for t in range(length)], "key string, pos int, v double")
    rows = P.series_correlation(side(0), side(1), ["key"], "pos", "v", length).toPandas()
    assert len(rows) == 3 * length
    for k, (x, y) in data.items():
        mine = rows[rows["key"].isna() if k is None else rows["key"] == k].sort_values("lag")
        assert mine["lag"].tolist() == list(range(length))
        assert np.allclose(mine["corr"], plain(x, y), atol=1e-9)


def test_a_key_of_one_side_and_missing_positions(spark):
    a = spark.createDataFrame([("k", 0, 2.0), ("k", 3, 4.0), ("only", 1, 1.0)], "key string, pos int, v double")
    b = spark.createDataFrame([("k", 1, 1.0), ("k", 3, 5.0), ("k", 4, 0.0)], "key string, pos int, v double")
    rows = {r.lag: r.corr for r in P.series_correlation(a, b, ["key"], "pos", "v", 5).collect()}
    x, y = {0: 2 - 6 / 5, 3: 4 - 6 / 5}, {1: 1 - 6 / 5, 3: 5 - 6 / 5, 4: -6 / 5}
    norm = np.sqrt(20 - 36 / 5) * np.sqrt(26 - 36 / 5)
    want = {lag: sum(x[p] * y[q] for p in x for q in y if (p - q) % 5 == lag) / norm for lag in range(5)}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-9 for k in want)
    assert P.series_correlation(a.limit(0), b, ["key"], "pos", "v", 5).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (16, 16), (13, 40), (64, 7)])
def test_planes(spark, shape):
    rng = np.random.default_rng(shape[0])
    x = rng.normal(size=shape)
    y = np.roll(x, (2, -1), (0, 1)) + 0.1 * rng.normal(size=shape)
    frame = lambda m: spark.createDataFrame([(1, i, j, float(m[i, j])) for i in range(shape[0]) for j in range(shape[1])], "key int, y int, x int, v double")
    surface = P.pattern_correlation(frame(x), frame(y), ["key"], "y", "x", "v", *shape).cache()
    got = surface.toPandas().sort_values(["lag_y", "lag_x"])
    want = plain(x, y)
    assert np.allclose(got["corr"].to_numpy().reshape(shape), want, atol=1e-9)
    r = P.pattern_peak(surface, ["key"], *shape, exclusion=2).first()
    c = np.fft.fftshift(want)
    py, px = np.unravel_index(np.argmax(np.abs(c)), shape)
    if shape[0] * shape[1] > 100:
        assert (r.offset_y, r.offset_x) == (py - shape[0] // 2, px - shape[1] // 2)
        mask = np.ones(shape, bool)
        mask[max(0, py - 2):py + 3, max(0, px - 2):px + 3] = False
        assert abs(r.pce - round(c[py, px] ** 2 / np.mean(c[mask] ** 2), 2)) < 0.011
        assert (r.offset_y, r.offset_x) == (-2, 1)


def test_long_series_stays_linear_logarithmic(spark):
    """100,003 positions: all lags right, and no stage sees more than a few rows a position."""
    n = 100_003
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=n), rng.normal(size=n)
    frame = lambda v: spark.createDataFrame(pd.DataFrame({"pos": np.arange(n), "v": v})).withColumn("key", F.lit("s"))
    out = P.series_correlation(frame(x), frame(y), ["key"], "pos", "v", n).toPandas().sort_values("lag")
    assert np.allclose(out["corr"], plain(x, y), atol=1e-9)
    assert P._room(n) < 4 * n

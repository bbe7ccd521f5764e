"""Circular correlation of series and of two-dimensional patterns by a distributed fast Fourier transform.

Every lag of two patterns of N positions costs N log N work and three
shuffles of about 2 N rows (4 N for a plane), instead of N * N pairs of
positions. A pattern is laid out as a grid of about sqrt(N) by sqrt(N); tasks
transform whole rows of the grid at once, then whole columns, so no task
holds more than its share of rows of length sqrt(N).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..session import cut

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _room(n: int) -> int:
    """Smallest power of two that holds all lags of `n` positions apart."""
    return 1 << max(0, 2 * n - 2).bit_length()


def _matrix(pdf: pd.DataFrame, place: str, value: str, width: int) -> np.ndarray:
    """Array columns of places and values as one row per line, zero where nothing is given."""
    out = np.zeros((len(pdf), width))
    if len(pdf):
        at = [np.asarray(p, np.int64) for p in pdf[place]]
        np.add.at(out, (np.repeat(np.arange(len(pdf)), [len(p) for p in at]), np.concatenate(at)), np.concatenate([np.asarray(v, float) for v in pdf[value]]))
    return out


def _lines(rows: DataFrame, line: str, place: str, values: Sequence[str]) -> DataFrame:
    """Rows of a grid gathered by line: arrays of their places and values, at most one line's length."""
    cells = F.collect_list(F.struct(place, *values)).alias("__c")
    return rows.groupBy("g", line).agg(cells).select("g", line, *[F.col(f"__c.{c}").alias(c) for c in (place, *values)])


def _long(g: np.ndarray, line: np.ndarray, **values: np.ndarray) -> dict:
    """(line, place) cells of matrices as columns."""
    n, width = next(iter(values.values())).shape
    return {"g": np.repeat(g, width), "line": np.repeat(line, width), "place": np.tile(np.arange(width), n)} | {k: v.ravel() for k, v in values.items()}


def _products(cells: DataFrame, first: int, second: int, twiddle: bool) -> DataFrame:
    """Linear correlation sums of two patterns on a grid: (g, u, w, s) with u along the lines (length `first`) and w across (length `second`).

    `cells`: g, line, place, x, y. With `twiddle` the grid is one series,
    position place * second + line (the four-step transform); without, it is
    a plane. Real input has a symmetric spectrum along the lines, of which
    half is carried.
    """
    half, size = first // 2 + 1, first * second

    def turned(line: np.ndarray, sign: float) -> np.ndarray:
        return np.exp(sign * 2j * np.pi * (line[:, None] * np.arange(half)[None, :] % size) / size)

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            line = pdf["line"].to_numpy(np.int64)
            x, y = (np.fft.rfft(_matrix(pdf, "place", c, first), axis=1) for c in ("x", "y"))
            if twiddle:
                by = turned(line, -1.0)
                x, y = x * by, y * by
            yield pd.DataFrame(_long(pdf["g"].to_numpy(), line, xr=x.real, xi=x.imag, yr=y.real, yi=y.imag))

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, y = (np.fft.fft(_matrix(pdf, "line", f"{c}r", second) + 1j * _matrix(pdf, "line", f"{c}i", second), axis=1) for c in "xy")
            z = np.fft.ifft(x * np.conj(y), axis=1)
            made = _long(pdf["g"].to_numpy(), pdf["place"].to_numpy(np.int64), zr=z.real, zi=z.imag)
            yield pd.DataFrame({"g": made["g"], "freq": made["line"], "line": made["place"], "zr": made["zr"], "zi": made["zi"]})

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            line = pdf["line"].to_numpy(np.int64)
            z = _matrix(pdf, "freq", "zr", half) + 1j * _matrix(pdf, "freq", "zi", half)
            made = _long(pdf["g"].to_numpy(), line, s=np.fft.irfft(z * turned(line, 1.0) if twiddle else z, first, axis=1))
            yield pd.DataFrame({"g": made["g"], "u": made["place"], "w": made["line"], "s": made["s"]})

    spectra = _lines(cells, "line", "place", ["x", "y"]).mapInPandas(forward, "g long, line long, place long, xr double, xi double, yr double, yi double")
    mixed = _lines(spectra, "place", "line", ["xr", "xi", "yr", "yi"]).mapInPandas(across, "g long, freq long, line long, zr double, zi double")
    return _lines(mixed, "line", "freq", ["zr", "zi"]).mapInPandas(back, "g long, u long, w long, s double")


def _folded(lag: Column, length: int, room: int) -> Column:
    """Circular lag of a linear one (negative ones at the end of the room); null for the unused ones between."""
    return F.when(lag < length, lag).when(lag > room - length, lag - room + length).cast("long")


def _prepared(a: DataFrame, b: DataFrame, keys: Sequence[str], places: Sequence[str], value: str, positions: int) -> tuple[DataFrame, DataFrame]:
    """(cells of both patterns about their means, numbered keys with the product of their norms); keys that only one side has are left out."""
    def stats(df: DataFrame, name: str) -> DataFrame:
        m = F.sum(value) / F.lit(positions)
        return df.groupBy(*keys).agg(m.alias(f"m{name}"), F.sqrt(F.greatest(F.sum(F.col(value) * F.col(value)) - m * m * positions, F.lit(0.0))).alias(f"n{name}"))

    known = cut(null_safe_join(stats(a, "x"), stats(b, "y"), list(keys)).withColumn("g", F.monotonically_increasing_id()))
    zero = F.lit(0.0)

    def side(df: DataFrame, name: str) -> DataFrame:
        centred = (F.col("__v") - F.col(f"m{name}")).cast("double")
        given = df.select(*keys, *[F.col(p).alias(f"__p{i}") for i, p in enumerate(places)], F.col(value).alias("__v"))
        return null_safe_join(given, known.select(*keys, "g", f"m{name}"), list(keys)).select(
            "g", *[F.col(f"__p{i}").cast("long").alias(f"p{i}") for i in range(len(places))], (centred if name == "x" else zero).alias("x"), (centred if name == "y" else zero).alias("y"))

    return side(a, "x").unionByName(side(b, "y")), known.select("g", *keys, (F.col("nx") * F.col("ny") + 1e-12).alias("norm"))


def series_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], pos: str, value: str, length: int) -> DataFrame:
    """Normalised circular correlation of two series of a key at every lag: (keys, lag, corr).

    corr at lag l is the sum over t of a[t + l] * b[t] about the means, over
    the product of the norms. Positions are 0 .. length - 1; one that is not
    given takes no part. Any length will do; null keys are keys.
    """
    room = _room(length)
    first = 1 << (room.bit_length() // 2)
    second = room // first
    cells, known = _prepared(a, b, keys, [pos], value, length)
    grid = cells.select("g", (F.col("p0") % second).alias("line"), F.floor(F.col("p0") / second).cast("long").alias("place"), "x", "y")
    sums = _products(grid, first, second, True).select("g", _folded(F.col("u") * second + F.col("w"), length, room).alias("lag"), "s").where("lag is not null")
    return sums.groupBy("g", "lag").agg(F.sum("s").alias("s")).join(known, "g").select(*keys, "lag", (F.col("s") / F.col("norm")).alias("corr"))


def pattern_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], y: str, x: str, value: str, height: int, width: int) -> DataFrame:
    """Normalised circular correlation surface of two planes of a key: (keys, lag_y, lag_x, corr), height * width rows a key."""
    tall, wide = _room(height), _room(width)
    cells, known = _prepared(a, b, keys, [y, x], value, height * width)
    grid = cells.select("g", F.col("p0").alias("line"), F.col("p1").alias("place"), "x", "y")
    sums = _products(grid, wide, tall, False).select("g", _folded(F.col("w"), height, tall).alias("lag_y"), _folded(F.col("u"), width, wide).alias("lag_x"), "s")
    each = sums.where("lag_y is not null and lag_x is not null").groupBy("g", "lag_y", "lag_x").agg(F.sum("s").alias("s"))
    return each.join(known, "g").select(*keys, "lag_y", "lag_x", (F.col("s") / F.col("norm")).alias("corr"))


def pattern_peak(surface: DataFrame, keys: Sequence[str], height: int, width: int, exclusion: int = 5) -> DataFrame:
    """Largest |correlation| of a surface (signed; ties: first in reading order), its offset from no shift, and peak^2 over the mean energy outside a square around it."""
    spot = lambda c, n: F.pmod(F.col(c) + F.lit(n // 2), F.lit(n))  # noqa: E731  no shift lies in the middle
    placed = surface.withColumns({"__py": spot("lag_y", height), "__px": spot("lag_x", width)})
    peak = placed.groupBy(*keys).agg(F.max_by(F.struct("corr", "__py", "__px"), F.struct(F.abs("corr"), -F.col("__py"), -F.col("__px"))).alias("__p"))
    inside = (F.abs(F.col("__py") - F.col("__p.__py")) <= exclusion) & (F.abs(F.col("__px") - F.col("__p.__px")) <= exclusion)
    energy = null_safe_join(placed, peak, list(keys)).where(~inside).groupBy(*keys).agg(F.avg(F.col("corr") * F.col("corr")).alias("__e"))
    c, e = F.col("__p.corr"), F.col("__e")
    pce = F.when(e.isNull(), 0.0).when(e <= 1e-12, c * c / 1e-12).otherwise(c * c / e)
    return null_safe_join(peak, energy, list(keys), "left").select(
        *keys, c.alias("peak"), (F.col("__p.__py") - height // 2).alias("offset_y"), (F.col("__p.__px") - width // 2).alias("offset_x"), F.round(pce, 2).alias("pce"))

"""Ordered and outlier operators: timelines, gaps, demeaning, residuals, curves, fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.joins import null_safe_join
from ..functions.numeric import robust_z
from ..functions.text import epoch_us
from ..functions.vectors import each_with, mean
from .grid import convolve, local_median
from .skew import Sequenced, quantiles
from .stats import robust_by


def timeline(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Rows of a key by time (unknown times first) with the seconds since the previous one."""
    out = Sequenced(df, [key], [ts, tie]).shift({"__prev": ts}, -1)
    gap = (epoch_us(F.col(ts)) - epoch_us(F.col("__prev"))) / 1e6
    return out.withColumn("gap_s", F.round(gap, 2)).drop("__prev")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The last row of every key: an aggregate that combines before the shuffle, not a sorted window."""
    last = F.max_by(F.struct(*carry), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__r")).select(*keys, "__r.*")


def sequence_gaps(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows whose number is not one more than the one before (the first must be 1)."""
    out = Sequenced(df, [key], [seq]).shift({"previous": seq}, -1)
    expected = F.coalesce(F.col("previous"), F.lit(0)) + 1
    return out.where(F.col(seq) != expected).withColumn("missing", F.col(seq) - expected)


def top_with_gap(df: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """Best item of every key, its score, the runner-up's score and the gap.

    The rank filter is pushed below the shuffle (WindowGroupLimit), so a key sends two rows per task.
    """
    w = W.partitionBy(*keys).orderBy(F.desc(score), item)
    two = df.withColumn("__rk", F.row_number().over(w)).where("__rk <= 2")
    first, second = F.col("__rk") == 1, F.col("__rk") == 2
    return two.groupBy(*keys).agg(F.max(F.when(first, F.col(item))).alias("top"), F.max(F.when(first, F.col(score))).alias("score"),
                                  F.max(F.when(second, F.col(score))).alias("second")).withColumn("gap", F.col("score") - F.col("second"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def demean(df: DataFrame, row_id: str, values: str) -> DataFrame:
    """Subtract row means, then column means, then the grand mean from a matrix of row arrays.

    Column means are one row of as many numbers as the matrix has columns.
    """
    rows = df.select(row_id, each_with(F.col(values), mean(F.col(values)), lambda x, m: x.cast("double") - m).alias("v"))
    cols = rows.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    one = cols.agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("c")).select(F.col("c.m").alias("cm"))
    centred = rows.join(F.broadcast(one)).select(row_id, F.zip_with("v", "cm", lambda x, m: x - m).alias("v"))
    grand = centred.agg(F.avg(mean(F.col("v"))).alias("g"))  # rows are equally long
    return centred.join(F.broadcast(grand)).select(row_id, each_with(F.col("v"), F.col("g"), lambda x, g: x - g).alias("v"))


def adaptive_residual(df: DataFrame, item: str, x: str, y: str, width: Column, height: Column, v: str, size: int = 5, sigma: float = 1.5,
                      chunk: int = 4096) -> DataFrame:
    """Local mean and variance shrinkage over a size x size box; residual = value - filtered."""
    taps = [1.0 / size] * size
    base = df.withColumn("__m", F.col(v)).withColumn("__q", F.col(v) * F.col(v)).withColumn("__w", width).withColumn("__h", height)
    for pos, other, n in ((y, x, "__h"), (x, y, "__w")):
        base = convolve(base, [item, other], pos, F.col(n), taps, {"__m": "__m", "__q": "__q"}, "reflect", chunk)
    var = F.greatest(F.lit(0.0), F.col("__q") - F.col("__m") * F.col("__m"))
    noise = sigma * sigma * 9.0
    shrink = F.least(F.greatest(var - noise, F.lit(0.0)) / (var + 1e-6), F.lit(1.0))
    filtered = F.col("__m") + shrink * (F.col(v) - F.col("__m"))
    return base.withColumn("residual", F.col(v) - filtered).drop("__m", "__q", "__w", "__h")


def smooth_residual(df: DataFrame, keys: Sequence[str], pos: str, length: Column, v: str, taps: Sequence[float], border: str = "reflect",
                    chunk: int = 4096) -> DataFrame:
    """Value minus its weighted moving average."""
    out = convolve(df, keys, pos, length, taps, {"smooth": v}, border, chunk)
    return out.withColumn("residual", F.col(v) - F.col("smooth"))


def median_residual(df: DataFrame, keys: Sequence[str], pos: str, length: Column, v: str, radius: int, chunk: int = 4096) -> DataFrame:
    out = local_median(df, keys, pos, length, radius, v, "smooth", "reflect", chunk)
    return out.withColumn("residual", F.col(v) - F.col("smooth"))


def derivatives(df: DataFrame, keys: Sequence[str], pos: str, length: Column, v: str, chunk: int = 4096) -> DataFrame:
    """Forward first difference and second difference, mirrored at the ends."""
    out = convolve(df, keys, pos, length, [0.0, -1.0, 1.0], {"d1": v}, "reflect", chunk)
    return convolve(out, keys, pos, length, [1.0, -2.0, 1.0], {"d2": v}, "reflect", chunk)


def periodicity(products: DataFrame, keys: Sequence[str], period: int = 8) -> DataFrame:
    """Autocorrelation at `period` above its neighbours' mean, percent of lag 0."""
    around = [period - 2, period - 1, period + 1, period + 2]
    p = F.col("product")
    agg = products.groupBy(*keys).agg(
        F.max(F.when(F.col("lag") == 0, p)).alias("r0"), F.max(F.when(F.col("lag") == period, p)).alias("r8"),
        F.avg(F.when(F.col("lag").isin(*around), p)).alias("near"))
    ratio = F.greatest(F.lit(0.0), F.col("r8") - F.col("near")) / (F.col("r0") + 1e-6)
    return agg.select(*keys, F.when(F.col("r0") > 1e-6, F.round(ratio * 100.0, 4)).otherwise(0.0).alias("periodicity"))


def curve_minima(curve: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Interior local minima of a swept curve, or its global minimum when there is none.

    A curve has one row per swept setting, so its window is short by construction.
    """
    w = W.partitionBy(*keys).orderBy(x)
    marked = curve.withColumn("__min", (F.col(y) < F.lag(y).over(w)) & (F.col(y) < F.lead(y).over(w)))
    flags = marked.groupBy(*keys).agg(F.max(F.coalesce("__min", F.lit(False))).alias("__any"), F.min(F.struct(F.col(y), F.col(x))).alias("__low"))
    out = null_safe_join(marked, flags, list(keys))
    pick = F.coalesce("__min", F.lit(False)) | (~F.col("__any") & (F.col(x) == F.col(f"__low.{x}")))
    return out.where(pick).select(*keys, x, y, F.col("__any").alias("is_local"))


def z_outliers(df: DataFrame, keys: Sequence[str], v: str, threshold: float) -> DataFrame:
    """Rows at least `threshold` deviations from their key's mean; flat keys have none."""
    stat = df.groupBy(*keys).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"))
    z = F.when(F.col("__s") > 1e-9, (F.col(v) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return null_safe_join(df, stat, list(keys)).withColumn("z", z).where(F.abs("z") >= threshold).drop("__m", "__s")


def robust_outliers(df: DataFrame, keys: Sequence[str], v: str, threshold: float) -> DataFrame:
    """As z_outliers with median and scaled MAD."""
    stat = robust_by(df, keys, v).drop("scale")
    return null_safe_join(df, stat, list(keys)).withColumn("z", robust_z(F.col(v), F.col("median"), F.col("mad"))) \
        .where(F.abs("z") >= threshold).drop("median", "mad")


def fence_outliers(df: DataFrame, keys: Sequence[str], v: str, below: float = 1.75, above: float = 2.5, floor: float = 0.001) -> DataFrame:
    """Rows below q50 - 1.75 IQR or above q50 + 2.5 IQR."""
    q = quantiles(df, keys, v, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    iqr = F.greatest(F.col("q75") - F.col("q25"), F.lit(floor))
    side = F.when(F.col(v) < F.col("q50") - below * iqr, "LOW").when(F.col(v) > F.col("q50") + above * iqr, "HIGH")
    return null_safe_join(df, q, list(keys)).withColumn("side", side).where("side is not null").drop("q25", "q50", "q75")

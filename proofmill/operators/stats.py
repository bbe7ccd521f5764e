"""Distribution statistics by key: summaries, histograms, correlation, circular and table statistics."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.joins import null_safe_join
from ..functions.numeric import angle_gap, clip, wrap_degrees
from .skew import ROWS_PER_BUCKET, quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

PERCENTILES = {"p5": 0.05, "median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def describe_by(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float] = PERCENTILES,
                rows_per_bucket: int = ROWS_PER_BUCKET, approximate: bool = False) -> DataFrame:
    """count, mean, population std, min, max and exact quantiles per key.

    `approximate` trades exact quantiles for one mergeable sketch pass.
    """
    moments = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
               F.min(value).alias("min"), F.max(value).alias("max")]
    if approximate:
        sketch = [F.percentile_approx(value, float(p), 10_000).cast("double").alias(n) for n, p in probs.items()]
        return df.groupBy(*keys).agg(*moments, *sketch)
    base = df.groupBy(*keys).agg(*moments)
    exact = quantiles(df, keys, value, probs, rows_per_bucket)
    return null_safe_join(base, exact, list(keys), "left")


def robust_by(df: DataFrame, keys: Sequence[str], value: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """median, mad and the 1.4826-scaled mad per key (two rank selections, no per-key buffering)."""
    centre = quantiles(df, keys, value, {"median": 0.5}, rows_per_bucket)
    dev = null_safe_join(df, centre, list(keys)).withColumn("__d", F.abs(F.col(value) - F.col("median"))).select(*keys, "__d")
    mad = quantiles(dev, keys, "__d", {"mad": 0.5}, rows_per_bucket)
    return null_safe_join(centre, mad, list(keys)).withColumn("scale", 1.4826 * F.col("mad"))


def bin_index(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """0-based equal-width bin, the upper edge inside the last bin, NULL outside."""
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    raw = F.floor((value - low) / (high - low) * bins)
    return F.when((value >= low) & (value <= high), F.least(raw, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Non-empty bins with count, share and cumulative share (at most `bins` rows per key)."""
    counted = df.withColumn("bin", bin_index(F.col(value), low, high, bins)).where("bin is not null") \
        .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return with_shares(counted, keys)


def with_shares(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys)
    run = w.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counted.withColumn("pdf", F.col("n") / F.sum("n").over(w)) \
        .withColumn("cdf", F.sum("n").over(run) / F.sum("n").over(w))


def trimmed_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 128, margin: float = 1.0) -> DataFrame:
    """Histogram over [p5 - margin, p95 + margin] of each key."""
    edges = quantiles(df, keys, value, {"p5": 0.05, "p95": 0.95})
    placed = null_safe_join(df, edges, list(keys)).withColumn(
        "bin", bin_index(F.col(value), F.col("p5") - margin, F.col("p95") + margin, bins)).where("bin is not null")
    return with_shares(placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")), keys)


def entropy(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shannon entropy in bits of the histogram's shares."""
    return hist.groupBy(*keys).agg((-F.sum(F.col("pdf") * F.log2("pdf"))).alias("entropy"))


def clipping(df: DataFrame, keys: Sequence[str], value: str, low: int, high: int) -> DataFrame:
    """Share at the extreme levels, range, and empty levels between minimum and maximum."""
    v = F.col(value)
    levels = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return levels.groupBy(*keys).agg(
        (F.sum(F.when(v == low, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("shadow_pct"),
        (F.sum(F.when(v == high, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("highlight_pct"),
        (F.max(v) - F.min(v)).cast("long").alias("dynamic_range"),
        (F.max(v) - F.min(v) + 1 - F.count(F.lit(1))).cast("long").alias("comb_gaps"))


def correlation_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson's r of every column pair; 1.0 where a column is flat. One pass over the rows."""
    pairs = list(combinations(columns, 2))
    aggs = [F.stddev_pop(c).alias(f"__s_{c}") for c in columns] + \
           [F.covar_pop(a, b).alias(f"__r_{a}_{b}") for a, b in pairs]
    one = df.groupBy(*keys).agg(*aggs)
    cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.when(
        (F.col(f"__s_{a}") < 1e-5) | (F.col(f"__s_{b}") < 1e-5), 1.0).otherwise(
            F.col(f"__r_{a}_{b}") / (F.col(f"__s_{a}") * F.col(f"__s_{b}"))).alias("r")) for a, b in pairs]
    return one.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def pair_differences(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """mean, std, max of |a - b| for every pair and for the mean over the pairs. One pass."""
    diffs = {f"{a}_{b}": F.abs(F.col(a) - F.col(b)) for a, b in combinations(columns, 2)}
    diffs["composite"] = sum(diffs.values(), F.lit(0.0)) / len(diffs)
    aggs = [agg(c).alias(f"__{n}_{k}") for k, c in diffs.items()
            for n, agg in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))]
    one = df.groupBy(*keys).agg(*aggs)
    cells = [F.struct(F.lit(k).alias("pair"), *[F.col(f"__{n}_{k}").alias(n) for n in ("mean", "std", "max")]) for k in diffs]
    return one.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def error_summary(df: DataFrame, keys: Sequence[str], a: str, b: str, gain: float = 20.0) -> DataFrame:
    """Summary of |a - b| and the share saturated after multiplying by `gain`."""
    d = df.withColumn("diff", F.abs(F.col(a) - F.col(b)))
    base = describe_by(d, keys, "diff", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    sat = d.groupBy(*keys).agg((F.avg((F.col("diff") * gain >= 255).cast("double")) * 100.0).alias("saturation_pct"))
    return null_safe_join(base, sat, list(keys))


def scaled(df: DataFrame, keys: Sequence[str], value: str, gain: float) -> DataFrame:
    """Per row: min-max scaled, max scaled and fixed-gain clipped value on 0..255."""
    edge = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    v = F.col(value)
    spread = F.col("__hi") - F.col("__lo")
    return null_safe_join(df, edge, list(keys)).withColumn(
        "minmax", F.when(spread > 0, (v - F.col("__lo")) / spread * 255.0).otherwise(0.0)) \
        .withColumn("max_scaled", F.when(F.col("__hi") > 0, v / F.col("__hi") * 255.0).otherwise(0.0)) \
        .withColumn("gained", clip(v * gain, 0.0, 255.0)).drop("__lo", "__hi")


def suitability(df: DataFrame, keys: Sequence[str], level: str, residual: str) -> DataFrame:
    """Weighted usability index of an item's values with its three-step status."""
    v = F.col(level)
    one = df.groupBy(*keys).agg(
        F.avg(((v <= 5.0) | (v >= 250.0)).cast("double")).alias("saturated_ratio"),
        (F.max(v) - F.min(v)).alias("dynamic_range"), F.var_pop(residual).alias("residual_variance"))
    var = F.col("residual_variance")
    index = (F.greatest(F.lit(0.0), 1.0 - F.col("saturated_ratio") * 2.0) * 0.5
             + F.least(F.lit(1.0), F.col("dynamic_range") / 128.0) * 0.3
             + F.when(var > 0, F.least(F.lit(1.0), var / 0.5)).otherwise(0.0) * 0.2)
    out = one.withColumn("suitability", F.round(clip(index, 0.0, 1.0), 4))
    return out.withColumn("status", F.when(F.col("suitability") >= 0.5, "SUITABLE")
                          .when(F.col("suitability") >= 0.25, "MARGINAL").otherwise("UNSUITABLE"))


def circular(df: DataFrame, keys: Sequence[str], angle: str, divergence: float = 45.0) -> DataFrame:
    """Mean direction in degrees, RMS spread around it, share of divergent rows, verdict."""
    rad = F.radians(angle)
    mean = df.groupBy(*keys).agg(wrap_degrees(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))).alias("mean_deg"))
    gap = angle_gap(F.col(angle), F.col("mean_deg"))
    out = null_safe_join(df, mean, list(keys)).groupBy(*keys).agg(
        F.first("mean_deg").alias("mean_deg"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(gap * gap)).alias("spread_deg"),
        F.avg((gap > divergence).cast("double")).alias("divergent_share"))
    share = F.col("divergent_share")
    return out.withColumn("verdict", F.when(share > 0.40, "LIGHTING_DIRECTION_ANOMALY")
                          .when(share > 0.20, "MODERATE_LIGHTING_VARIANCE").otherwise("LIGHTING_PHYSICS_CONSISTENT"))


# The standard luminance quantization table of ITU-T T.81, Annex K.
STANDARD_TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)


def quality_tables() -> np.ndarray:
    """The 100 tables of the usual quality scaling, row q-1 for quality q."""
    q = np.arange(1, 101)[:, None]
    scale = np.where(q < 50, 5000.0 / q, 200.0 - 2.0 * q)
    return np.clip(np.floor((np.array(STANDARD_TABLE)[None, :] * scale + 50) / 100), 1, 255)


def table_statistics(df: DataFrame, key: str, table: str) -> DataFrame:
    """DC, summary of all 64 values, and the nearest of the 100 quality tables (lowest on ties).

    A constant 100 x 64 reference against an Arrow batch of tables; nothing is exploded or shuffled.
    """
    refs = quality_tables()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            t = np.array(pdf[table].tolist(), dtype=np.float64)
            mad = np.stack([np.abs(t - r).mean(1) for r in refs], axis=1)
            best = mad.argmin(1)
            ac = t[:, 1:]
            yield pd.DataFrame({
                key: pdf[key], "dc": t[:, 0].astype("int64"), "mean": t.mean(1), "median": np.median(t, axis=1),
                "variance": t.var(1), "std": t.std(1), "ac_mean": ac.mean(1), "ac_median": np.median(ac, axis=1),
                "min": t.min(1).astype("int64"), "max": t.max(1).astype("int64"),
                "quality": (best + 1).astype("int64"), "mad": mad[np.arange(len(t)), best]})

    schema = (f"{key} long, dc long, mean double, median double, variance double, std double, ac_mean double, "
              "ac_median double, min long, max long, quality long, mad double")
    out = df.select(key, table).mapInPandas(run, schema)
    fits = F.col("mad") <= 2.5
    return out.withColumn("status", F.when(fits, "ESTIMATED").otherwise("NOT_ESTIMATED")) \
        .withColumn("confidence", F.when(~fits, "NONE").when(F.col("mad") == 0, "HIGH").when(F.col("mad") < 1.0, "MODERATE").otherwise("LOW")) \
        .withColumn("quality", F.when(fits, F.col("quality")))


def fingerprint_census(df: DataFrame, digest: str, standard: DataFrame) -> DataFrame:
    """Corpus count per digest, and whether the digest is on the `standard` list (column `digest`)."""
    counted = df.groupBy(F.col(digest).alias("digest")).agg(F.count(F.lit(1)).alias("items"))
    marked = standard.select("digest").distinct().withColumn("__std", F.lit(True))
    return counted.join(marked, "digest", "left").withColumn(
        "kind", F.when(F.col("__std"), "STANDARD").otherwise("CUSTOM")).drop("__std")


def energy_ratios(df: DataFrame, keys: Sequence[str], signal: str, residual: str) -> DataFrame:
    """Residual energy over signal energy, and full-scale dB of the residual."""
    r, s = F.col(residual), F.col(signal)
    return df.groupBy(*keys).agg((F.sum(r * r) / F.sum(s * s)).alias("energy_ratio"),
                                 (20.0 * F.log10(255.0 / (F.stddev_pop(r) + 1e-6))).alias("full_scale_db"))

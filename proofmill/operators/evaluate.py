"""Detector evaluation: confusion counts, threshold sweeps, reference patterns, correlation peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import numeric as N
from ..functions.joins import null_safe_join


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn per key; their sum is the number of rows."""
    return df.groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))


def detection_metrics(counts: DataFrame, policy: str = "strict") -> DataFrame:
    """Overlap, precision, recall and the rest as columns beside tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*", N.iou(tp, fp, fn, policy).alias("iou"), N.precision(tp, fp).alias("precision"), N.recall(tp, fn).alias("recall"),
        N.f1(tp, fp, fn, policy).alias("f1"), N.dice(tp, fp, fn, policy).alias("dice"), N.false_positive_rate(fp, tn).alias("fpr"),
        N.specificity(tn, fp).alias("specificity"), N.accuracy(tp, fp, fn, tn).alias("accuracy"))


def threshold_sweep(df: DataFrame, keys: Sequence[str], score: str, label: str, thresholds: Sequence[float], policy: str = "strict") -> DataFrame:
    """Detection metrics at several thresholds in one aggregation: rows are never multiplied."""
    actual = N.truth(F.col(label), policy)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = N.positive(F.col(score), t, policy)
        for name, cond in (("tp", hit & actual), ("fp", hit & ~actual), ("fn", ~hit & actual), ("tn", ~hit & ~actual)):
            aggs.append(F.count_if(cond).alias(f"__{name}{i}"))
    wide = df.groupBy(*keys).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"__{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")])
                      for i, t in enumerate(thresholds)])
    return detection_metrics(wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*"), policy)


def reference_pattern(df: DataFrame, source: str, pos: str, residual: str, intensity: str, eps: float = 1e-6) -> DataFrame:
    """K = sum(W I) / (sum(I^2) + eps) per source and position, then zero mean and unit deviation per source."""
    w, i = F.col(residual), F.col(intensity)
    k = df.groupBy(source, pos).agg((F.sum(w * i) / (F.sum(i * i) + eps)).alias("k"))
    s = W.partitionBy(source)  # one row per position of a pattern
    centred = k.withColumn("k", F.col("k") - F.avg("k").over(s)).withColumn("sd", F.stddev_pop("k").over(s))
    return centred.select(source, pos, F.when(F.col("sd") > 1e-12, F.col("k") / F.col("sd")).otherwise(F.col("k")).alias("k"))


def peak_to_energy(lags: DataFrame, keys: Sequence[str], length: int, exclusion: int = 5) -> DataFrame:
    """Largest |correlation| (reported signed), its offset, and peak^2 over the mean energy away from it."""
    spot = F.pmod(F.col("lag") + F.lit(length // 2), F.lit(length))  # zero lag in the middle
    placed = lags.withColumn("spot", spot)
    peak = placed.groupBy(*keys).agg(F.max_by(F.struct("corr", "spot"), F.struct(F.abs("corr"), -F.col("spot"))).alias("p"))
    away = null_safe_join(placed, peak, list(keys)).where(F.abs(F.col("spot") - F.col("p.spot")) > exclusion)
    energy = away.groupBy(*keys).agg(F.avg(F.col("corr") * F.col("corr")).alias("energy"))
    out = null_safe_join(peak, energy, list(keys), "left")
    c, e = F.col("p.corr"), F.col("energy")
    pce = F.when(e.isNull(), 0.0).when(e <= 1e-12, c * c / 1e-12).otherwise(c * c / e)
    return out.select(*keys, c.alias("peak"), (F.col("p.spot") - length // 2).alias("offset"), F.round(pce, 2).alias("pce"))

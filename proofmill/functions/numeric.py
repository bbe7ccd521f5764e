"""Arithmetic, detection and fidelity metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    return F.count(F.lit(1))


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def ratio(num: Column, den: Column, empty: float | None) -> Column:
    """num / den, or `empty` when the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


def wrap_degrees(col: Column) -> Column:
    return F.pmod(col + F.lit(360.0), F.lit(360.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Smaller angle between two directions in degrees."""
    d = F.abs(a - b)
    return F.when(d > 180.0, F.lit(360.0) - d).otherwise(d)


def positive(score: Column, threshold: float, policy: str) -> Column:
    """Prediction mask: `strict` counts the threshold itself, `bench` does not."""
    return score >= threshold if policy == "strict" else score > threshold


def truth(label: Column, policy: str) -> Column:
    """Ground truth mask on the 0..255 scale."""
    return label > 0 if policy == "strict" else label > 127


# The empty-mask value is 1.0 for overlap scores under `strict`, 0.0 under `bench`.
def _empty(policy: str) -> float:
    return 1.0 if policy == "strict" else 0.0


def iou(tp: Column, fp: Column, fn: Column, policy: str = "strict") -> Column:
    return ratio(tp, tp + fp + fn, _empty(policy))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp, 0.0)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn, 0.0)


def f1(tp: Column, fp: Column, fn: Column, policy: str = "strict") -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn, _empty(policy))


dice = f1


def false_positive_rate(fp: Column, tn: Column) -> Column:
    return ratio(fp, fp + tn, 0.0)


def specificity(tn: Column, fp: Column) -> Column:
    return ratio(tn, tn + fp, 0.0)


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return ratio(tp + tn, tp + fp + fn + tn, 0.0)


def psnr(mse: Column, data_range: float = 255.0, policy: str = "strict") -> Column:
    """Decibels; identical inputs give +inf under `strict`, 100 under `bench`."""
    same = F.lit(float("inf")) if policy == "strict" else F.lit(100.0)
    return F.when(mse <= 0.0, same).otherwise(10.0 * F.log10(F.lit(data_range * data_range) / mse))


def robust_z(v: Column, median: Column, mad: Column) -> Column:
    """(v - median) / (1.4826 MAD); a zero scale counts as 1."""
    scale = 1.4826 * mad
    return (v - median) / F.when(scale > 1e-9, scale).otherwise(F.lit(1.0))


def backoff_seconds(attempt: Column, cap: int = 300, max_power: int = 8) -> Column:
    return F.least(F.lit(float(cap)), F.pow(F.lit(2.0), F.least(attempt, F.lit(max_power))))


def full_scale_db(std: Column) -> Column:
    return 20.0 * F.log10(255.0 / (std + 1e-6))

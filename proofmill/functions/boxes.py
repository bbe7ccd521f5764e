"""Boxes are structs (x1, y1, x2, y2); other conventions are converted on read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def from_size(x: Column, y: Column, w: Column, h: Column) -> Column:
    return corners(x, y, x + w, y + h)


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def aspect_delta(aspect_a: Column, aspect_b: Column) -> Column:
    """Relative difference of two width/height ratios."""
    return F.abs(aspect_a - aspect_b) / F.greatest(aspect_a, aspect_b, F.lit(1e-6))


def normalised(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Relative position in 0..1 and size in 0.01..1, four decimals."""
    def keep(c: Column, low: float) -> Column:
        return F.round(F.least(F.greatest(c, F.lit(low)), F.lit(1.0)), 4)
    return [keep(x / width, 0.0).alias("x"), keep(y / height, 0.0).alias("y"),
            keep(w / width, 0.01).alias("width"), keep(h / height, 0.01).alias("height")]

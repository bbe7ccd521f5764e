"""Mergeable quantile sketches as counted rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantile_sketch(measures: DataFrame, groups: list[str], names: list[str], accuracy: float = 0.01) -> DataFrame:
    """Mergeable quantile sketches of the columns `names` (values of 0 or more): rows (groups, measure, bucket, n).

    Buckets grow by a fixed ratio, so a quantile is known within `accuracy` of
    its value; two sketches merge by adding the counts of equal buckets. At
    most a few hundred rows per group, counted before the shuffle, and the
    same rows in whatever order the data come.
    """
    ratio = math.log((1 + accuracy) / (1 - accuracy))
    bucket = lambda v: F.when(v > 0, F.ceil(F.log(v) / ratio).cast("int"))
    long = measures.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names])).alias("m"))
    return long.groupBy(*groups, "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The sketch of a coarser grouping."""
    return sketch.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, groups: list[str], shares: dict[str, float], accuracy: float = 0.01) -> DataFrame:
    """One row per group and measure: total and the value at each share (the bucket's middle; 0 for the bucket of zeros)."""
    ratio = math.log((1 + accuracy) / (1 - accuracy))
    by = W.partitionBy(*groups, "measure")
    value = F.coalesce(F.exp((F.col("bucket") - 0.5) * ratio), F.lit(0.0))
    run = sketch.withColumns({"run": F.sum("n").over(by.orderBy(F.col("bucket").asc_nulls_first())), "total": F.sum("n").over(by), "value": value})
    return run.groupBy(*groups, "measure").agg(F.max("total").alias("total"), *[
        F.min(F.when(F.col("run") >= F.ceil(F.col("total") * s), F.col("value"))).alias(name) for name, s in shares.items()])

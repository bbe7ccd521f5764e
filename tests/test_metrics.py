"""Closed forms and zero-denominator policies of the metric expressions."""

import math

import pytest
from pyspark.sql import functions as F

from proofmill.functions import boxes, numeric as N


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("policy,empty", [("strict", 1.0), ("bench", 0.0)])
def test_empty_masks(spark, policy, empty):
    zero = F.lit(0)
    assert value(spark, N.iou(zero, zero, zero, policy)) == empty
    assert value(spark, N.f1(zero, zero, zero, policy)) == empty
    assert value(spark, N.precision(zero, zero)) == 0.0
    assert value(spark, N.recall(zero, zero)) == 0.0
    assert value(spark, N.false_positive_rate(zero, zero)) == 0.0


def test_detection_values(spark):
    tp, fp, fn, tn = (F.lit(x) for x in (6, 2, 4, 88))
    assert value(spark, N.iou(tp, fp, fn)) == 0.5
    assert value(spark, N.precision(tp, fp)) == 0.75
    assert value(spark, N.recall(tp, fn)) == 0.6
    assert value(spark, N.f1(tp, fp, fn)) == pytest.approx(2 / 3)
    assert value(spark, N.accuracy(tp, fp, fn, tn)) == 0.94


def test_psnr(spark):
    assert value(spark, N.psnr(F.lit(0.0))) == math.inf
    assert value(spark, N.psnr(F.lit(0.0), policy="bench")) == 100.0
    assert value(spark, N.psnr(F.lit(1.0))) == pytest.approx(20 * math.log10(255))


def test_thresholds(spark):
    edge = F.lit(64.0)
    assert value(spark, N.positive(edge, 64.0, "strict")) is True
    assert value(spark, N.positive(edge, 64.0, "bench")) is False


def test_boxes(spark):
    a = boxes.corners(*[F.lit(float(v)) for v in (0, 0, 10, 10)])
    b = boxes.from_size(*[F.lit(float(v)) for v in (5, 0, 10, 10)])
    assert value(spark, boxes.box_iou(a, b)) == pytest.approx(50 / 150)
    far = boxes.corners(*[F.lit(float(v)) for v in (20, 20, 30, 30)])
    assert value(spark, boxes.box_iou(a, far)) == 0.0


def test_backoff(spark):
    got = [value(spark, N.backoff_seconds(F.lit(k))) for k in (1, 3, 8, 20)]
    assert got == [2.0, 8.0, 256.0, 256.0]


def test_lighting_verdicts(spark):
    """Night outranks direction, both outrank divergence; shadows come before light; no place, no astronomical verdict."""
    from proofmill.functions.solar import with_lighting_verdict, with_sun_position
    rows = [(1, -5.0, 100.0, 0.5, 280.0, None), (2, 30.0, 100.0, 0.1, 280.0, None), (3, 30.0, 100.0, 0.1, 190.0, None), (4, 30.0, 100.0, 0.3, 280.0, 250.0), (5, 30.0, 350.0, 0.3, 200.0, None),
            (6, None, None, 0.5, 10.0, None), (7, 30.0, 100.0, 0.9, None, None), (8, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, elevation double, shadow_azimuth double, share double, light double, shadow double")
    got = {r.i: (r.consistency, r.verdict, round(r.score, 6), r.direction) for r in with_lighting_verdict(df, "share", "light", "shadow").collect()}
    assert got == {
        1: ("DAY_NIGHT_CONFLICT", "SOLAR_NIGHT_CONFLICT", 0.75, "anomalous"), 2: ("CONSISTENT", "LIGHTING_PHYSICS_CONSISTENT", 0.15, "consistent"),
        3: ("INCONSISTENT", "SOLAR_ASTRONOMICAL_ANOMALY", 0.75, "anomalous"), 4: ("INCONSISTENT", "SOLAR_ASTRONOMICAL_ANOMALY", 0.75, "anomalous"),
        5: ("CONSISTENT", "MODERATE_LIGHTING_VARIANCE", 0.45, "anomalous"), 6: (None, "LIGHTING_DIRECTION_ANOMALY", 0.75, "anomalous"),
        7: ("CONSISTENT", "LIGHTING_DIRECTION_ANOMALY", 1.0, "anomalous"), 8: (None, "LIGHTING_PHYSICS_CONSISTENT", 0.0, "consistent")}
    from pyspark.sql import functions as F
    noon = spark.sql("select 48.0 as lat, 11.0 as lon, timestamp'2024-06-21 12:00:00' as utc, timestamp'2024-06-21 14:00:00' as here")
    a = with_sun_position(noon, "lat", "lon", "utc").first()
    b = with_sun_position(noon, "lat", "lon", "here", zone=F.lit(2)).first()
    assert abs(a.elevation - b.elevation) < 1e-9 and abs(a.azimuth - b.azimuth) < 1e-9 and 63 < a.elevation < 66 and 0.4 < a.shadow_ratio < 0.6
    night = with_sun_position(noon.withColumn("utc", F.expr("timestamp'2024-06-21 00:00:00'")), "lat", "lon", "utc").first()
    assert night.elevation < 0 and night.shadow_ratio == 99.0

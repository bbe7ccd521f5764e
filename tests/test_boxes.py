"""Box overlaps in adaptive tiles against brute force."""

import numpy as np
import pandas as pd
import pytest

from proofmill.operators import matching as M


def rows(spark, boxes):
    return spark.createDataFrame([(i, item, None if b is None else tuple(float(v) for v in b)) for i, (item, b) in enumerate(boxes)],
                                 "id long, item string, box struct<x1:double,y1:double,x2:double,y2:double>")


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def brute(pred, truth):
    out = []
    for i, (item, a) in enumerate(pred):
        found = [iou(a, b) for b in {b for other, b in truth if other == item}]
        out.append((i, round(max(found, default=0.0), 9), sum(v > 0.3 for v in found)))
    return out


def scattered(rng, n):
    """Six of ten boxes crowd one small place of one item; sizes differ by a factor of a thousand; some are equal."""
    out = []
    for _ in range(n):
        hot = rng.random() < 0.6
        x, y = rng.uniform(0, 5 if hot else 1000, 2).round(1)
        w, h = (10 ** rng.uniform(-1, 2, 2)).round(1)
        out.append(("hot" if hot or rng.random() < 0.3 else f"i{rng.integers(3)}", (x, y, x + w, y + h)))
    return out + out[:5]


@pytest.mark.parametrize("crowd, block", [(1 << 20, 4096), (200, 4096), (20, 7)])
def test_box_matches(spark, crowd, block):
    rng = np.random.default_rng(4)
    pred, truth = scattered(rng, 160), scattered(rng, 140)
    got = M.box_matches(rows(spark, pred), rows(spark, truth), crowd=crowd, block=block).collect()
    assert sorted((r.id, round(r.best_iou, 9), r.matches) for r in got) == brute(pred, truth)
    assert all(r.matched == (r.best_iou > 0.3) for r in got)


def test_boxes_on_one_line_and_on_top(spark):
    """Equal low corners cannot be cut, boxes on one line can be cut along it only."""
    line = [("a", (float(i), 0.0, i + 1.5, 1.0)) for i in range(300)]
    pile = [("b", (0.0, 0.0, 1.0 + i, 1.0 + i)) for i in range(40)]
    got = M.box_matches(rows(spark, line + pile), rows(spark, pile + line), crowd=100, block=9).collect()
    assert sorted((r.id, round(r.best_iou, 9), r.matches) for r in got) == brute(line + pile, pile + line)


def test_crowded_place_spreads(spark):
    """A place with 60 % of all boxes ends in tiles of bounded size, with few copies of a box."""
    rng = np.random.default_rng(9)
    n = 4000
    spots = np.where(rng.random((n, 1)) < 0.6, rng.uniform(0, 1, (n, 2)), rng.uniform(0, 1000, (n, 2)))
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "x": spots[:, 0], "y": spots[:, 1]})).selectExpr(
        "id", "'one' as item", "named_struct('x1', x, 'y1', y, 'x2', x + 0.004, 'y2', y + 0.004) as box")
    seen = []
    kept = M.cut
    try:
        M.cut = lambda d: seen.append(kept(d)) or seen[-1]
        M.box_matches(df, df, crowd=1000).count()
    finally:
        M.cut = kept
    tiles = [d for d in seen if d.columns == ["item", "tile", "p", "t"]]
    assert 2 < len(tiles) <= 6 and tiles[-1].where("p * t > 1000").isEmpty()
    assert [d for d in seen if "predicted" in d.columns][-1].count() < 4 * n


def test_boxes_without_area(spark):
    pred = [("a", (0, 0, 1, 1)), (None, (0, 0, 1, 1)), ("a", None), ("a", (2, 2, 2, 3)), ("a", (0, 0, float("inf"), 1)), ("z", (0, 0, 1, 1)), ("a", (float("nan"), 0, 1, 1))]
    truth = [("a", (0, 0, 1, 1)), (None, (0, 0, 1, 1)), ("a", (0, 0, 0, 0)), ("a", None)]
    got = {r.id: (r.best_iou, r.matches, r.matched) for r in M.box_matches(rows(spark, pred), rows(spark, truth)).collect()}
    assert got == {0: (1.0, 1, True)} | {i: (0.0, 0, False) for i in range(1, 7)}
    nothing = rows(spark, truth).limit(0)
    assert M.box_matches(nothing, rows(spark, truth)).count() == 0
    assert [r.best_iou for r in M.box_matches(rows(spark, pred[:1]), nothing).collect()] == [0.0]

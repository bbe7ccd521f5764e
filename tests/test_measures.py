"""User measures over whole keys: complete frames, repeated walks, flat memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofmill.operators import measures as M


def skewed(spark, rows):
    """60 % of the rows in key 1, the rest over 40 keys and a null key."""
    key = F.when(F.col("id") % 10 < 6, 1).when(F.col("id") % 97 == 0, None).otherwise(2 + F.col("id") % 40)
    return spark.range(rows).select(key.cast("long").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7.0).alias("v"), F.col("id").alias("at"))


def spread_by_ranks():
    def spread(frames):
        def median(value):
            found = M.order_statistics(frames, value, lambda n: ((n - 1) // 2, n // 2), cells=64)
            return sum(found) / 2 if found else None
        sizes = [len(f) for f in frames]
        middle = median(lambda f: f["v"].to_numpy())
        return pd.DataFrame({"key": [frames.key[0]], "n": [frames.rows], "most": [max(sizes)], "median": [middle],
                             "mad": [median(lambda f: abs(f["v"].to_numpy() - middle))]})
    return spread


def test_measure_that_does_not_merge(spark):
    df = skewed(spark, 300_000)
    got = M.whole_key_measure(df, ["key"], spread_by_ranks(), "key double, n long, most long, median double, mad double", keep=True).toPandas()
    plain = df.toPandas()
    assert len(got) == plain["key"].nunique(dropna=False)
    for r in got.itertuples():
        v = plain[plain["key"].isna() if np.isnan(r.key) else plain["key"] == r.key]["v"]
        assert r.n == len(v)
        assert np.isclose(r.median, v.median()) and np.isclose(r.mad, (v - v.median()).abs().median())
    batch = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    assert got["n"].max() == 180_000 and got["most"].max() <= batch


def test_order_of_rows_and_early_stop(spark):
    def firsts(frames):
        for frame in frames:  # the rest of the key is never read
            yield frame.iloc[:1][["key", "at"]]
            return
    df = skewed(spark, 50_000).where("key is not null")
    got = M.whole_key_measure(df, ["key"], firsts, "key long, at long", order=["at"])
    assert {(r.key, r["at"]) for r in got.collect()} == {(r.key, r["at"]) for r in df.groupBy("key").agg(F.min("at").alias("at")).collect()}


def test_second_walk(spark):
    def twice(frames):
        for frame in frames:
            break
        return pd.DataFrame({"key": [frames.key[0]], "n": [sum(len(f) for f in frames)]})
    df = skewed(spark, 40_000).where("key is not null")
    got = M.whole_key_measure(df, ["key"], twice, "key long, n long", keep=True)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.groupBy("key").count().collect()}
    with pytest.raises(Exception, match="keep=True"):
        M.whole_key_measure(df, ["key"], twice, "key long, n long").collect()


def test_two_keys_and_empty_table(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, "x", 2.0), (None, None, 3.0), (1, "x", 4.0)], "a long, b string, v double")
    count = lambda frames: pd.DataFrame({"n": [sum(len(f) for f in frames)]})
    assert sorted(r.n for r in M.whole_key_measure(df, ["a", "b"], count, "n long").collect()) == [1, 1, 2]
    assert M.whole_key_measure(df.limit(0), ["a", "b"], count, "n long").count() == 0


def test_order_statistics_edges():
    class Held(list):
        pass
    value = lambda f: f["v"].to_numpy()
    for v in ([], [5.0], [1.0, 1.0, 1.0], [0.0, np.nan, 3.0, -np.inf], list(np.random.default_rng(0).normal(size=5000)), [1.0] * 600 + [1.0 + 2 ** -52] * 600):
        frames = Held(pd.DataFrame({"v": v[i:i + 700]}) for i in range(0, max(1, len(v)), 700))
        kept = sorted(x for x in v if np.isfinite(x))
        got = M.order_statistics(frames, value, lambda n: (0, n // 3, n - 1), cells=8)
        assert got == ([kept[0], kept[len(kept) // 3], kept[-1]] if kept else [])


def scans(df):
    """Scans of the items in the executed plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ")


def test_many_measures_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.range(500).select(F.col("id").alias("item_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("F"), F.col("id") % 3)).alias("format"), (F.col("id") * 1.5).alias("x")).write.parquet(path)
    items = spark.read.parquet(path)
    reg = M.Registry()
    for i in range(23):
        reg.register(M.Measure(f"m{i}", "c", (f"F{i % 3}", "F9"), applicable=lambda i=i: F.col("x") > 10 * i, metrics={"v": F.col("x") + i, "none": F.when(F.col("x") < 0, 1.0)}))
    out = reg.run(items)
    assert scans(out) == 1
    plain = items.toPandas()
    want = {(r.item_id, f"m{i}", r.x + i) for i in range(23) for r in plain.itertuples() if r.format == f"F{i % 3}" and r.x > 10 * i}
    got = [(r.item_id, r.engine, r.normalized_value) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    for i in range(5):
        reg.register(M.Measure(f"a{i}", "c", ("F1", "F2"), aggregates={"s": (F.sum, F.col("x") * i), "n": (F.count, F.col("x"))}))
    reg.register(M.Measure("free", "c", ("F1",), lambda df: df.select("item_id", F.lit("k").alias("metric_name"), F.col("x").alias("normalized_value"))))
    assert scans(reg.run(items)) == 3
    assert reg.run(items, ["a0", "a1"]).count() == reg.run(items, ["a0", "a1"]).distinct().count()
    with pytest.raises(ValueError):
        reg.register(M.Measure("none", "c", ("F1",)))
    with pytest.raises(ValueError):
        M.Registry().run(items)


def test_grouped_measure_calls_once_a_batch(spark):
    """A batch with thousands of keys is one call, and its partial rows still merge."""
    df = spark.range(0, 30_000, 1, 3).select((F.col("id") % 9_000).alias("key"), F.col("id").alias("v"))

    def partial(pdf):
        out = pdf.groupby("key").agg(n=("v", "size"), total=("v", "sum")).reset_index()
        return out.assign(calls=[1] + [0] * (len(out) - 1))
    got = M.grouped_measure(df, ["key"], partial, "key long, n long, total long, calls long").toPandas()
    batch = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    assert got["calls"].sum() <= 3 * -(-10_000 // batch)
    merged = got.groupby("key")[["n", "total"]].sum()
    want = df.toPandas().groupby("key")["v"].agg(["size", "sum"])
    assert (merged["n"] == want["size"]).all() and (merged["total"] == want["sum"]).all()

"""Bucketed windows equal plain ones, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest

from proofmill.operators.skew import Sequenced, global_rank, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": np.where(rng.random(600) < 0.6, 0, rng.integers(1, 9, 600)), "t": rng.integers(0, 150, 600).astype(float),
                        "i": np.arange(600), "v": rng.integers(0, 50, 600).astype(float)})
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def plain(rows):
    return rows[0].sort_values(["k", "t", "i"])


def indexed(df, col):
    return df.toPandas().set_index("i")[col].sort_index()


@pytest.mark.parametrize("size", [40, 10_000])
def test_sequenced(rows, plain, size):
    seq = Sequenced(rows[1], ["k"], ["t", "i"], rows_per_bucket=size)
    g = plain.groupby("k")
    want = plain.assign(prev=g["v"].shift(1), nxt=g["v"].shift(-1), ordn=g.cumcount() + 1, run=g["v"].cumsum()).set_index("i").sort_index()
    assert np.array_equal(indexed(seq.shift({"p": "v"}, -1), "p").astype(float), want["prev"], equal_nan=True)
    assert np.array_equal(indexed(seq.shift({"p": "v"}, 1), "p").astype(float), want["nxt"], equal_nan=True)
    assert (indexed(seq.ordinal("o"), "o") == want["ordn"]).all()
    assert np.allclose(indexed(seq.running_sum({"s": "v"}), "s"), want["run"])


@pytest.mark.parametrize("size", [40, 10_000])
def test_quantiles(rows, size):
    got = quantiles(rows[1], ["k"], "v", {"q": 0.3, "m": 0.5}, rows_per_bucket=size).toPandas().set_index("k").sort_index()
    g = rows[0].groupby("k")["v"]
    assert np.allclose(got["q"], g.quantile(0.3)) and np.allclose(got["m"], g.median())


def test_global_rank(rows):
    got = indexed(global_rank(rows[1], ["t", "i"], "r"), "r")
    want = rows[0].sort_values(["t", "i"]).reset_index(drop=True).reset_index().set_index("i")["index"].sort_index()
    assert (got == want).all()


@pytest.fixture(scope="module")
def null_rows(spark):
    """A null key, a hot key, and order values that share a long prefix."""
    rng = np.random.default_rng(3)
    keys = [None if x < 0.2 else "hot" if x < 0.8 else f"k{int(x * 100) % 5}" for x in rng.random(500)]
    rows = [(k, f"EVIDENCE_STORAGE_PATH_{int(t):06d}", i, float(v)) for i, (k, t, v) in enumerate(zip(keys, rng.integers(0, 200, 500), rng.integers(0, 40, 500)))]
    return spark.createDataFrame(rows, "k string, name string, i long, v double")


def test_plans_agree_on_null_keys(null_rows):
    def answers(size):
        seq = Sequenced(null_rows, ["k"], ["name", "i"], rows_per_bucket=size)
        out = seq.shift({"p": "v"}), seq.ordinal("o"), seq.running_sum({"s": "v"}), seq.fill_next({"f": "v"}), quantiles(null_rows, ["k"], "v", {"a": 0.25, "b": 0.5}, size)
        return [sorted(map(tuple, df.collect()), key=str) for df in out]
    assert answers(20) == answers(1_000_000)


def test_many_buckets_for_one_prefix(null_rows):
    seq = Sequenced(null_rows, ["k"], ["name", "i"], rows_per_bucket=20)
    assert seq.df.groupBy("__b").count().agg({"count": "max"}).first()[0] < 120


def test_parts_of_a_hot_key_are_small(null_rows):
    """Tasks get an eighth of the rows that make a table large, not all of them."""
    seq = Sequenced(null_rows, ["k"], ["name", "i"], rows_per_bucket=400)
    assert not seq.single and seq.df.groupBy("__b").count().agg({"count": "max"}).first()[0] < 250


def test_no_hot_key_needs_no_parts(spark):
    """Many rows of many small keys are dealt out by key, with the same answers as the plain plan."""
    df = spark.range(2_000).selectExpr("nullif(id % 150, 7) as k", "id as i", "pmod(xxhash64(id), 97) / 3.0 as v")

    def answers(size):
        seq = Sequenced(df, ["k"], ["v", "i"], rows_per_bucket=size)
        out = seq.shift({"p": "v"}), seq.ordinal("o"), quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5}, size).selectExpr("k", "round(a, 9)", "round(b, 9)")
        return seq.single, [sorted(map(tuple, d.collect()), key=str) for d in out]
    assert answers(200) == answers(1_000_000) and answers(200)[0]

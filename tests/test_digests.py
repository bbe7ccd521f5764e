"""Digest trees: equal sets, changed records, few digests compared."""

import pytest
from pyspark.sql import functions as F

from proofmill.operators import digests as D


def items(spark, n=20_000):
    return spark.range(n).select(F.col("id").alias("evidence_id"), F.concat(F.lit("note "), F.col("id") % 97).alias("intake_notes"), (F.col("id") * 3).alias("file_size"))


def tree(df, depth=3, keys=("evidence_id",), content=("intake_notes", "file_size")):
    return D.digest_tree(df, keys, content, depth)


def test_order_and_partitions_do_not_matter(spark):
    a, b = tree(items(spark).repartition(3)), tree(items(spark).orderBy(F.rand(1)).repartition(11))
    assert a.root() == b.root() and len(a.root()) == 64
    parts, compared = D.differing_parts(a, b)
    assert parts.isEmpty() and compared == 1
    assert D.tree_difference(a, b).isEmpty()


def test_one_change_is_found_by_few_digests(spark):
    n, depth = 20_000, 3
    changed = items(spark, n).withColumn("file_size", F.when(F.col("evidence_id") == 12_345, -1).otherwise(F.col("file_size")))
    a, b = tree(items(spark, n)), tree(changed)
    parts, compared = D.differing_parts(a, b)
    assert parts.count() == 1 and compared <= 1 + 16 * depth
    assert [tuple(r) for r in D.tree_difference(a, b).collect()] == [(12_345, "CHANGED")]


def test_kinds_copies_nulls(spark):
    schema = "evidence_id long, case_id string, note string"
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, None), (None, "b", "y"), (4, "c", "z"), (4, "c", "z"), (5, "", None)], schema)
    right = spark.createDataFrame([(1, "a", "x"), (2, "a", "X"), (3, None, ""), (None, "b", "y"), (4, "c", "z"), (5, "", None), (6, "n", None), (None, "", "y")], schema)
    for depth in (0, 1, 2):
        got = {tuple(r) for r in D.tree_difference(*(tree(t, depth, ("evidence_id", "case_id"), ("note",)) for t in (left, right))).collect()}
        assert got == {(2, "a", "CHANGED"), (3, None, "CHANGED"), (4, "c", "CHANGED"), (6, "n", "ADDED"), (None, "", "ADDED")}
    back = {tuple(r) for r in D.tree_difference(*(tree(t, 1, ("evidence_id", "case_id"), ("note",)) for t in (right, left))).collect()}
    assert (6, "n", "REMOVED") in back


def test_empty_sets_and_depths(spark):
    none = items(spark, 0)
    assert tree(none).root() is None
    assert {r.kind for r in D.tree_difference(tree(none), tree(items(spark, 30))).collect()} == {"ADDED"}
    with pytest.raises(ValueError):
        D.differing_parts(tree(items(spark, 5), 1), tree(items(spark, 5), 2))
    assert [D.depth_for(n) for n in (0, 1000, 1001, 16_000, 16_001, 10**9)] == [0, 0, 1, 1, 2, 5]


def test_fields_cannot_run_into_each_other(spark):
    a = spark.createDataFrame([(1, "ab", "c")], "k int, x string, y string")
    b = spark.createDataFrame([(1, "a", "bc")], "k int, x string, y string")
    assert D.digest_tree(a, ["k"], ["x", "y"], 1).root() != D.digest_tree(b, ["k"], ["x", "y"], 1).root()

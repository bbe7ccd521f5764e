"""Merkle manifests against a plain tree."""

import brute
import pytest
from pyspark.sql import functions as F

from proofmill.llm.merkle import merkle_manifest

SCHEMA = "evidence_id long, source_platform string, case_id long, file_size long, intake_notes string"


def expected(rows, change, fanout):
    made = []
    for i, s, c, n, t in rows:
        seen = n + 1 if n is not None and change(i) else n
        made.append((c, i, brute.leaf(i, s, c, n, t), brute.leaf(i, s, c, seen, t)))
    return sorted((str(i), h, sub, root, path, fold, fold == root) for i, h, sub, root, path, fold in brute.merkle(made, fanout))


def seen(df):
    return sorted((str(r.evidence_id), r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.siblings], r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_plain_tree(spark, fanout):
    """Cases of 1 to 70 records, a null case, null fields and ids, repeated rows."""
    rows = [(100 * c + i, f"p{i % 3}", c, i * 7, f"note é {i}") for c, size in enumerate((1, 2, 3, 16, 17, 70)) for i in range(size)]
    rows += [(9000 + i, None, None, None, None) for i in range(5)] + [(None, "x", 3, 4, ""), (None, "y", 3, 4, ""), (5000, "a", 2, 1, "t"), (5000, "a", 2, 1, "t")]
    odd = lambda i: i is not None and i % 3 == 0
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit("z") for c in ("tree", "pos", "n", "hash", "item", "siblings")})
    got = merkle_manifest(df, presented={"file_size": F.when(F.col("evidence_id") % 3 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))}, fanout=fanout)
    assert seen(got) == expected(rows, odd, fanout)


def test_single_case_and_single_record(spark):
    one = [(1, "p", 7, 3, "text")]
    assert seen(merkle_manifest(spark.createDataFrame(one, SCHEMA))) == expected(one, lambda i: False, 2)
    many = [(i, "p", 7, 3, "text") for i in range(300)]
    got = seen(merkle_manifest(spark.createDataFrame(many, SCHEMA)))
    assert got == expected(many, lambda i: False, 2)
    assert all(r[6] for r in got) and {len(r[4]) for r in got} == {9}


def test_empty_table_and_fanout(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(none).count() == 0
    with pytest.raises(ValueError):
        merkle_manifest(none, fanout=1)


def test_other_columns(spark, records):
    """Records without a case: the platform is the tree; long and odd texts are hashed whole."""
    got = merkle_manifest(records, tree_col="source_platform", fields=("evidence_id", "intake_notes"))
    rows = [(r.source_platform, r.evidence_id, h, h) for r in records.collect() for h in [brute.leaf(r.evidence_id, r.intake_notes)]]
    want = sorted((str(i), h, sub, root, path, fold, True) for i, h, sub, root, path, fold in brute.merkle(rows))
    assert seen(got) == want

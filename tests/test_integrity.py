"""Chains with one altered row, one gap and one broken link; rules and upserts on small tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from proofmill.operators import integrity as G
from proofmill.plans import integrity_q as I
from proofmill.session import cut
from proofmill.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    rows = I.audit_rows(spark, SF).where("case_id <= 3")
    return cut(G.build_chain(rows, ["ts", "id"]).join(rows, ["case_id", "id"]))


def found(events):
    return {(r.case_id, r.sequence_number, r.violation) for r in G.verify_chain(events).collect()}


def test_segments_give_the_same_chain(spark):
    rows = I.audit_rows(spark, SF)
    whole, parts = G.build_chain(rows, ["ts", "id"]), G.build_chain(rows, ["ts", "id"], segment=9)
    assert parts.count() == whole.count() and parts.exceptAll(whole).isEmpty()


def test_intact_chain(chain):
    assert found(chain) == set()
    assert {r.status for r in G.chain_status(chain, G.verify_chain(chain)).collect()} == {"VERIFIED"}


def test_altered_row(chain):
    case = chain.agg(F.min("case_id")).first()[0]
    hit = (F.col("case_id") == case) & (F.col("sequence_number") == 4)
    assert found(chain.withColumn("actor", F.when(hit, "x").otherwise(F.col("actor")))) == {(case, 4, "EVENT_HASH_MISMATCH")}


def test_gap_and_broken_link(chain):
    case = chain.agg(F.min("case_id")).first()[0]
    gap = chain.where(~((F.col("case_id") == case) & (F.col("sequence_number") == 3)))
    assert found(gap) == {(case, 4, "SEQUENCE_GAP"), (case, 4, "PREVIOUS_HASH_MISMATCH")}
    hit = (F.col("case_id") == case) & (F.col("sequence_number") == 2)
    broken = chain.withColumn("previous_hash", F.when(hit, "0" * 64).otherwise(F.col("previous_hash")))
    assert found(broken) == {(case, 2, "PREVIOUS_HASH_MISMATCH"), (case, 2, "EVENT_HASH_MISMATCH")}


def test_absent_and_partial_chain(chain):
    none = chain.withColumn("sequence_number", F.lit(None).cast("long")).withColumn("previous_hash", F.lit(None).cast("string")) \
        .withColumn("event_hash", F.lit(None).cast("string"))
    empty = chain.select("case_id").limit(0).withColumn("violation", F.lit(""))
    assert {r.status for r in G.chain_status(none, empty).collect()} == {"NOT_PRESENT"}
    half = chain.withColumn("event_hash", F.when(F.col("sequence_number") > 2, F.col("event_hash")))
    assert {r.status for r in G.chain_status(half, empty).collect()} == {"PARTIAL"}


def test_custody_states(spark):
    items = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "cc"), (4, "dd")], "k long, recorded string")
    stored = spark.createDataFrame([(1, "AA"), (2, "xx"), (3, None)], "k long, actual string")
    got = {r.k: r.status for r in G.custody_check(items, stored, "k").collect()}
    assert got == {1: "VERIFIED_INTACT", 2: "TAMPER_OR_BITROT_DETECTED", 3: "READ_ERROR", 4: "FILE_MISSING"}


def test_rules_report_every_error(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 3], "digest": ["0" * 64, "zz", "0" * 64]}))
    errors = G.validate(df, "k", {"BAD_DIGEST": G.bad_digest(F.col("digest"))}, unique=["digest"])
    assert {(r.key, r.rule) for r in errors.collect()} == {(2, "BAD_DIGEST"), (1, "DUPLICATE_DIGEST"), (3, "DUPLICATE_DIGEST")}
    v = G.verdict(df, errors).first()
    assert (v.rows, v.bad_rows, v.errors, v.status) == (3, 3, 3, "INVALID")


def test_transition_table(spark):
    pairs = spark.createDataFrame([("GENERATED", "DISMISSED"), ("ACKNOWLEDGED", "GENERATED"), ("GENERATED", "GENERATED")], "a string, b string")
    assert [r.ok for r in pairs.select(G.allowed_change(F.col("a"), F.col("b")).alias("ok")).collect()] == [True, False, False]


def test_fingerprint_ignores_partitions(spark):
    rows = I.run_rows(spark, SF)
    a = G.run_fingerprint(rows.repartition(3), ["engine"])
    b = G.run_fingerprint(rows.repartition(7, "status"), ["engine"])
    assert a.exceptAll(b).isEmpty()


def test_upsert_keeps_fixed_columns(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k long, v string, created string")
    new = spark.createDataFrame([(2, "B", "t1"), (3, "C", "t1")], "k long, v string, created string")
    got = sorted(tuple(r) for r in sinks.upsert(old, new, ["k"], keep=["created"]).collect())
    assert got == [(1, "a", "t0", "KEPT"), (2, "B", "t0", "UPDATED"), (3, "C", "t1", "INSERTED")]


def test_fingerprints_of_several_runs_in_one_scan(spark):
    """Each run's digest is that of its rows alone; equal sets agree, one changed or missing row does not; millions of equal words do not overflow."""
    rows = spark.range(6000).select((F.col("id") % 700).cast("string").alias("item"), (F.col("id") % 5).alias("engine"), F.lit("ok").alias("status"))
    runs = {"a": F.col("status"), "b": F.col("status"), "c": F.when(F.col("item") == "17", "bad").otherwise(F.col("status")), "d": F.when(F.col("item") != "17", F.col("status"))}
    got = {r.engine: r for r in G.run_fingerprints(rows, ["engine"], runs).collect()}
    alone = {r.engine: r for r in G.run_fingerprint(rows, ["engine"]).collect()}
    short = {r.engine: r for r in G.run_fingerprint(rows.where("item <> '17'"), ["engine"]).collect()}
    for e, r in got.items():
        assert (r.rows_a, r.fingerprint_a) == (alone[e].rows, alone[e].fingerprint) and r.fingerprint_b == r.fingerprint_a
        assert (r.rows_d, r.fingerprint_d) == (short[e].rows, short[e].fingerprint)
    has = {r.engine for r in rows.where("item = '17'").select("engine").distinct().collect()}
    assert {e for e, r in got.items() if r.fingerprint_c != r.fingerprint_a} == has == {e for e, r in got.items() if r.rows_d != r.rows_a}


def test_verification_shuffles_no_texts(spark):
    """Rows are hashed where they are read; the sort by case carries hashes only."""
    rows = spark.range(50).selectExpr("id", "id % 3 as case_id", "cast(null as string) as evidence_id", "'x' as event_type", "'t' as timestamp", "'a' as actor",
                                      "repeat('y', 5000) as safe_metadata", "id as ts")
    events = rows.join(G.build_chain(rows, ["ts", "id"]), ["case_id", "id"])
    found = G.verify_chain(events.withColumn("actor", F.when(F.col("id") == 9, "b").otherwise(F.col("actor"))))
    assert [tuple(r) for r in found.select("id", "violation").collect()] == [(9, "EVENT_HASH_MISMATCH")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__head" not in plan[:plan.index("Window")]

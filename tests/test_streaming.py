"""Streams over several files give the batch answers; late and out-of-order rows are reported."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from proofmill.operators import integrity as G
from proofmill.plans import integrity_q as I
from proofmill.plans.streaming_q import audit_stream
from proofmill.schemas import TABLES
from proofmill.sources import load
from proofmill.streaming import jobs as J
from proofmill.streaming import state as ST

SF = "/root/testdata/sf0.001"


def write_parts(spark, path, parts):
    """One file per part, in arrival order."""
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """The events table in three files by time."""
    root = str(tmp_path_factory.mktemp("events"))
    e = load(spark, SF, "events")
    a, b = e.select(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), array(0.4, 0.7))").alias("p")).first()["p"]
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    write_parts(spark, f"{root}/events.parquet", [e.where(t <= a), e.where((t > a) & (t <= b)), e.where(t > b)])
    return root


def test_chain_over_batches_equals_batch(spark, split):
    live = J.run_to_table(J.live_chain(audit_stream(J.event_stream(spark, split, files_per_trigger=1))), "t-chain")
    assert {r.outcome for r in live.select("outcome").distinct().collect()} == {"LINKED"}
    batch = G.build_chain(I.audit_rows(spark, SF), ["ts", "id"])
    assert live.drop("outcome").exceptAll(batch).isEmpty() and live.count() == batch.count()


def test_intake_and_transitions_over_batches(spark, split):
    live = J.run_to_table(J.live_intake(I.requests_of(J.event_stream(spark, split, files_per_trigger=1)), ["user_id", "event_type"]), "t-intake")
    batch = G.resolve_intake(I.intake_requests(spark, SF), ["user_id", "event_type"], ["ts", "event_id"], "fp").select(*live.columns)
    assert live.exceptAll(batch).isEmpty() and live.count() == batch.count()
    moves = J.run_to_table(J.live_transitions(I.states_of(J.event_stream(spark, split, files_per_trigger=1))), "t-moves")
    batch = G.bad_transitions(I.states(spark, SF), "user_id", ["ts", "event_id"], "status").select(*moves.columns)
    assert moves.exceptAll(batch).isEmpty() and moves.count() == batch.count()


def test_out_of_order_event_is_reported(spark, tmp_path):
    e = load(spark, SF, "events")
    user = e.first()["user_id"]
    mine = e.where(F.col("user_id") == user).orderBy("ts", "event_id").limit(3).collect()
    path = str(tmp_path / "events.parquet")
    write_parts(spark, path, [spark.createDataFrame([r], TABLES["events"]) for r in (mine[0], mine[2], mine[1])])
    live = J.run_to_table(J.live_chain(audit_stream(J.event_stream(spark, str(tmp_path), files_per_trigger=1))), "t-late")
    assert {(r.id, r.outcome) for r in live.collect()} == {
        (mine[0].event_id, "LINKED"), (mine[2].event_id, "LINKED"), (mine[1].event_id, "OUT_OF_ORDER")}


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    e = load(spark, SF, "events").orderBy("ts")
    rows = e.collect()
    path = str(tmp_path / "events.parquet")
    late = [rows[0], rows[1]]
    write_parts(spark, path, [spark.createDataFrame(part, TABLES["events"]) for part in (rows[2:-1], rows[-1:], late)])  # a watermark holds from the batch after it is known
    out = J.live_activity(J.event_stream(spark, str(tmp_path), files_per_trigger=1), ["event_type"], "tumbling")
    query, table = J.start_table(out, "t-windows")
    query.awaitTermination()
    assert J.late_rows(query) >= 1
    assert spark.read.parquet(table).agg(F.sum("n")).first()[0] <= len(rows) - 2


def test_stale_jobs(spark):
    jobs = spark.createDataFrame([(1, "RUNNING", 0, None), (2, "QUEUED", None, 0), (3, "RUNNING", 99_000_000, None), (4, "COMPLETED", 0, 0)],
                                 "id long, status string, started_us long, queued_us long")
    assert {r.id for r in J.stale_jobs(jobs, 901_000_000).collect()} == {1, 2}


def test_replacing_sink(spark, split, tmp_path):
    path = str(tmp_path / "by-type")
    rows = J.event_stream(spark, split).select("event_id", "event_type")
    for run in ("first", "second"):  # a second run of the same files leaves one copy
        J.replacing_sink(rows, path, ["event_type"], state=str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(path).count() == load(spark, SF, "events").count()


@pytest.mark.parametrize("limit", [1, 7, 64, 1000, 5000])
def test_sorted_pieces(limit):
    """Any cut into pieces gives the whole order, equal times and repeated rows included, and no piece is much longer than the limit."""
    rng = np.random.default_rng(limit)
    rows = pd.DataFrame({"ts_us": rng.integers(0, 40, 1500) * 10**15, "event_id": rng.integers(0, 300, 1500), "x": range(1500)})
    frames = np.split(rows, sorted(rng.integers(0, 1500, 12).tolist()))
    got = list(ST.sorted_pieces(iter(frames), limit))
    both = pd.concat(got, ignore_index=True)
    want = rows.sort_values(["ts_us", "event_id"], ignore_index=True)
    assert both[["ts_us", "event_id"]].equals(want[["ts_us", "event_id"]]) and sorted(both["x"]) == list(range(1500))
    longest = max(len(f) for f in frames)
    assert max(len(p) for p in got) <= max(limit + longest, (1500 // max(1, limit) + 2) * max(1, limit // 16))
    assert list(ST.sorted_pieces(iter([]))) == []


def test_hot_key_in_one_batch(spark, tmp_path):
    """250,000 events of one case and some of others in one trigger: more than two pieces, the chain of the batch job."""
    n = 250_000
    assert n > 2 * ST.PIECE_ROWS
    e = load(spark, SF, "events").limit(1).select("event_type", "value", "props")
    rows = spark.range(n + 500).select("id").crossJoin(e).select(
        F.col("id").alias("event_id"), F.when(F.col("id") < n, 7).otherwise(F.col("id") % 50 + 100).cast("long").alias("user_id"), "event_type", "value", "props",
        F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(10**9)) * 1000).alias("ts"))
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES["events"].fields])
    write_parts(spark, str(tmp_path / "events.parquet"), [typed])
    live = J.run_to_table(J.live_chain(audit_stream(J.event_stream(spark, str(tmp_path)))), "t-hot")
    assert live.groupBy("outcome").count().collect() == [("LINKED", n + 500)]
    moved = J.run_to_table(J.live_intake(I.requests_of(J.event_stream(spark, str(tmp_path))), ["user_id", "event_type"]), "t-hot-intake")
    assert moved.where("resolution = 'NEW'").count() == 51
    batch = G.build_chain(I.audit_rows(spark, str(tmp_path)), ["ts", "id"])
    assert live.drop("outcome").exceptAll(batch).isEmpty() and batch.count() == n + 500


@pytest.mark.parametrize("limit", [5, 1000])
def test_sorted_rows(limit):
    """Rows of a key come in order, whether they fit at once or not."""
    made = [Row(ts_us=int(t), event_id=i, fp=str(i)) for i, t in enumerate(np.random.default_rng(2).integers(0, 9, 200))]
    got = list(ST.sorted_rows(iter(made), limit))
    assert [(r.ts_us, r.event_id, r.fp) for r in got] == sorted((r.ts_us, r.event_id, r.fp) for r in made)


def test_requests_are_resolved_row_by_row():
    """No frame is built for a key: most keys bring one or two rows."""
    assert not issubclass(ST.FirstWins, ST.Keyed)

"""G: live jobs over the events table as a file stream, and their windowed batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import row_count
from ..session import fresh_dir
from ..sources import load
from ..streaming import jobs as J
from . import integrity_q as I
from .registry import ORACLES, query

FAILED, SUCCESS = ("error", "view"), "purchase"


def audit_stream(stream):
    return stream.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), F.lit(None).cast("string").alias("evidence_id"), "event_type",
        F.date_format("ts", I.ISO).alias("timestamp"), F.lit("system").alias("actor"), F.col("props").alias("safe_metadata"), "ts_us")


@query("g01_live_chain", ORACLES["i01_chain_build"])
def live_chain(spark, d):
    out = J.run_to_table(J.live_chain(audit_stream(J.event_stream(spark, d))), "g01")
    return out.where("outcome = 'LINKED'").drop("outcome")


@query("g01_live_outcomes", "select user_id as case_id, 'LINKED' as outcome, count(*) as n from events group by 1")
def live_outcomes(spark, d):
    """Numbers of linked and of out-of-order events per case; nothing that arrived is missing from the sum."""
    out = J.run_to_table(J.live_chain(audit_stream(J.event_stream(spark, d))), "g01-all")
    return out.groupBy("case_id", "outcome").agg(row_count().alias("n"))


@query("g02_live_intake", ORACLES["i08_idempotent_intake"])
def live_intake(spark, d):
    requests = I.requests_of(J.event_stream(spark, d))
    return J.run_to_table(J.live_intake(requests, ["user_id", "event_type"]), "g02")


@query("g03_job_timeouts", """with e as (select event_id, user_id, epoch_us(ts) as t, event_type in ('signup', 'view', 'click') as is_open, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as nx from events)
select user_id as job_id, event_id, t + 900000000 as failed_us from e where is_open and (nx > t + 900000000 or (nx is null and t + 900000000 < (select max(t) from e) - 3600000000))""")
def job_timeouts(spark, d):
    e = J.event_stream(spark, d).withColumn("is_open", F.col("event_type").isin("signup", "view", "click"))
    return J.run_to_table(J.live_timeouts(e.select("user_id", "event_id", "ts", "ts_us", "is_open"), "user_id"), "g03")


@query("g04_retry_schedule", """with f as (select *, event_type = 'purchase' as ok, sum((event_type = 'purchase')::integer) over (partition by user_id order by ts, event_id) as grp from events where event_type in ('error', 'view', 'purchase')),
a as (select event_id, epoch_us(ts) as t, count(*) filter (where not ok) over (partition by user_id, grp order by ts, event_id) as attempt, ok from f)
select event_id, attempt, least(300, pow(2, least(attempt, 8)))::double as delay_s, t + (least(300, pow(2, least(attempt, 8))) * 1000000)::bigint as next_us from a where not ok""")
def retry_schedule(spark, d):
    e = J.event_stream(spark, d).where(F.col("event_type").isin(*FAILED, SUCCESS)).withColumn("ok", F.col("event_type") == SUCCESS)
    return J.run_to_table(J.live_retries(e.select("user_id", "event_id", "ts_us", "ok"), "user_id"), "g04")


@query("g05_live_transitions", ORACLES["i12_bad_transitions"])
def live_transitions(spark, d):
    return J.run_to_table(J.live_transitions(I.states_of(J.event_stream(spark, d))), "g05")


@query("g06_live_counts", "select user_id, event_type, count(*) as n from events group by 1, 2")
def live_counts(spark, d):
    path = fresh_dir(spark, "g06")
    J.live_counts(J.event_stream(spark, d), ["user_id", "event_type"], path).awaitTermination()
    return J.latest_counts(spark, path, ["user_id", "event_type"])


H, Q = 3_600_000_000, 900_000_000


def typed_events(spark, d):
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("g07_tumbling_activity", f"select event_type, epoch_us(ts) // {H} * {H} as start_us, epoch_us(ts) // {H} * {H} + {H} as end_us, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def tumbling_activity(spark, d):
    return J.activity(typed_events(spark, d), ["event_type"], "tumbling")


@query("g07_sliding_activity", f"""with w as (select event_type, value, (epoch_us(ts) // {Q} - unnest(range(0, 4))) * {Q} as start_us from events)
select event_type, start_us, start_us + {H} as end_us, count(*) as n, round(sum(value), 4) as total from w group by 1, 2""")
def sliding_activity(spark, d):
    return J.activity(typed_events(spark, d), ["event_type"], "sliding")


@query("g07_session_activity", """with e as (select user_id, value, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts) as p from events),
s as (select *, sum((p is null or t > p + 1800000000)::integer) over (partition by user_id order by t) as sid from e)
select user_id, min(t) as start_us, max(t) + 1800000000 as end_us, count(*) as n, round(sum(value), 4) as total from s group by user_id, sid""")
def session_activity(spark, d):
    return J.activity(typed_events(spark, d), ["user_id"], "session")


@query("g07_live_activity", f"""select event_type, epoch_us(ts) // {H} * {H} as start_us, epoch_us(ts) // {H} * {H} + {H} as end_us, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3
having end_us <= (select max(epoch_us(ts)) // 1000 * 1000 - {H} from events)""")
def live_activity(spark, d):
    """Append mode: only windows the watermark has closed are written."""
    return J.run_to_table(J.live_activity(J.event_stream(spark, d), ["event_type"], "tumbling"), "g07")


@query("g08_observation_log", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def observation_log(spark, d):
    path = fresh_dir(spark, "g08")
    rows = J.event_stream(spark, d).select("event_id", "user_id", "event_type", "value")
    J.observation_log(rows, path).awaitTermination()
    back = spark.read.schema(rows.schema).json(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

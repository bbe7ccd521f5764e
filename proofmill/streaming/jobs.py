"""Live jobs: the same answers as their batch twins, kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.numeric import row_count
from ..functions.text import epoch_us
from ..operators.integrity import TRANSITIONS, chain_text
from ..schemas import TABLES
from ..session import fresh_dir
from ..sources.sinks import replace_partitions
from . import state as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1000) -> DataFrame:
    """A table followed as a file stream; `ts_us` is its event time in microseconds."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a pattern, as a plain stream path must be a folder and the table may be one file
    src = spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")
    return src.withColumn("ts_us", epoch_us(F.col("ts"))).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(out: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run everything available into a Parquet sink and read it back."""
    query, path = start_table(out, tag, mode)
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def start_table(out: DataFrame, tag: str, mode: str = "append") -> tuple[StreamingQuery, str]:
    path = fresh_dir(out.sparkSession, tag)
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    return writer.format("parquet").option("path", path).start(), path


def stateful(stream: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    """Apply a processor per key, on frames (`Keyed`) or on rows; large state lives in RocksDB, not on the heap."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    grouped = stream.groupBy(*keys)
    apply = grouped.transformWithStateInPandas if isinstance(processor, S.Keyed) else grouped.transformWithState
    return apply(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)


def live_chain(events: DataFrame) -> DataFrame:
    """Audit events linked to their case's head as they arrive; texts are prepared outside the state."""
    kind = events.schema["case_id"].dataType.simpleString()
    text = chain_text(events).select("case_id", F.col("id").alias("event_id"), "ts_us", *[F.col(f"__{c}").alias(c) for c in ("head", "mid", "tail")])
    return stateful(text, ["case_id"], S.ChainAppend(),
                    f"case_id {kind}, id long, sequence_number long, previous_hash string, event_hash string, outcome string")


def live_intake(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """requests: keys, event_id, ts_us, fp."""
    return stateful(requests, keys, S.FirstWins(), "event_id long, fp string, resolution string")


def live_transitions(changes: DataFrame) -> DataFrame:
    """changes: user_id, event_id, ts_us, status."""
    return stateful(changes, ["user_id"], S.StatusChanges(TRANSITIONS), "event_id long, user_id long, old_status string, status string")


def live_retries(attempts: DataFrame, key: str, cap: int = 300, max_power: int = 8) -> DataFrame:
    """attempts: key, event_id, ts_us, ok."""
    return stateful(attempts, [key], S.RetrySchedule(cap, max_power), "event_id long, attempt long, delay_s double, next_us long")


def live_timeouts(jobs: DataFrame, key: str, limit_s: int = 900, late: str = "1 hour") -> DataFrame:
    """jobs: key, event_id, ts, ts_us, is_open. One row per job that stayed open too long."""
    return stateful(jobs.withWatermark("ts", late), [key], S.JobTimeout(limit_s * 1_000_000), "job_id long, event_id long, failed_us long", "EventTime")


def stale_jobs(jobs: DataFrame, now_us: int, limit_s: int = 900) -> DataFrame:
    """Batch twin for one table of current jobs: status, started_us, queued_us."""
    cutoff = now_us - limit_s * 1_000_000
    s = F.col("status")
    return jobs.where((s.isin("RUNNING", "RETRYING") & (F.col("started_us") < cutoff)) | ((s == "QUEUED") & (F.col("queued_us") < cutoff)))


def live_counts(stream: DataFrame, keys: Sequence[str], path: str) -> StreamingQuery:
    """Counts per key: every batch writes the changed rows as its own version under `path`."""
    counts = stream.groupBy(*keys).agg(row_count().alias("n"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a repeated batch overwrites itself
    return counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}-state") \
        .trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def activity(events: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Counts per tumbling hour, sliding hour, or session; the same expression for tables and streams."""
    span = {"tumbling": F.window("ts", "1 hour"), "sliding": F.window("ts", "1 hour", "15 minutes"), "session": F.session_window("ts", "30 minutes")}[kind]
    out = events.groupBy(*keys, span.alias("w")).agg(row_count().alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(*keys, epoch_us(F.col("w.start")).alias("start_us"), epoch_us(F.col("w.end")).alias("end_us"), "n", "total")


def live_activity(stream: DataFrame, keys: Sequence[str], kind: str, late: str = "1 hour") -> DataFrame:
    return activity(stream.withWatermark("ts", late), keys, kind)


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped so far."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def observation_log(stream: DataFrame, path: str) -> StreamingQuery:
    """Append every observation as one JSON line, exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()


def replacing_sink(stream: DataFrame, path: str, keys: Sequence[str], state: str | None = None) -> StreamingQuery:
    """Each micro-batch replaces the partitions it brings."""
    return stream.writeStream.foreachBatch(lambda batch, _: replace_partitions(batch, path, keys)) \
        .option("checkpointLocation", state or f"{path}-state").trigger(availableNow=True).start()

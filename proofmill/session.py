"""Session settings, the shared work folder, and reliable lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job here wants; all are ordinary Spark options.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "proofmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the defaults above; `extra` overrides them (use _ for .)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is named, a temporary folder is made in local mode only, where
    driver and executors are one process. On a cluster it would lie on each
    machine's own disk, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {sc.master} share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="proofmill-ckpt-"))
    return sc.getCheckpointDir()


STEPS: list[str] = []


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new, not yet existing folder under the shared work folder; `drop_steps` removes it."""
    path = os.path.join(checkpoint_root(spark), f"{tag}-{uuid.uuid4().hex}")
    STEPS.append(path)
    return path


def drop_steps(spark: SparkSession) -> int:
    """Remove the folders written by this process so far; call it once their results have been read or written out.

    Returns how many were removed. Whatever is left at the end of a job lies
    in the shared folder only.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while STEPS:
        path = jvm.org.apache.hadoop.fs.Path(STEPS.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder as columnar files and read back.

    Losing executors loses nothing, the plan restarts from a scan, and later
    reads prune columns and row groups.
    """
    path = fresh_dir(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_step(step: DataFrame) -> None:
    """Remove the files of a `cut` whose rows nothing reads any more."""
    spark = step.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in step.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        STEPS[:] = [s for s in STEPS if os.path.basename(s) != os.path.basename(folder)]


@contextmanager
def holding(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that hold inside only."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def steady(spark: SparkSession) -> Iterator[None]:
    """Every scan inside is split alike, however many executors there are by then, and shuffle files are removed when their query ends.

    What is needed later is written by `cut`.
    """
    with holding(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                         "spark.sql.leafNodeDefaultParallelism": str(spark.sparkContext.defaultParallelism)}):
        yield


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """`steady`, and what is written inside is packed tightly."""
    with steady(spark), holding(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        yield

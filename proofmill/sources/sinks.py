"""Writers: JSON lines, partition replacement, upsert, snapshots, bundle manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_observations(df: DataFrame, path: str) -> None:
    """One JSON object per observation, one file per task."""
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str], processed: DataFrame | None = None) -> None:
    """Replace exactly the partitions present in `df`: a re-run leaves one copy.

    `processed` holds the keys that were run; those without any row in `df`
    are cleared too. Rows are rebalanced by key: a hot key is split over as
    many tasks as its size asks for, small keys share one.
    """
    if processed is not None:
        _clear(processed.select(*keys).distinct().join(df.select(*keys).distinct(), list(keys), "left_anti"), path, keys)
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _clear(gone: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Remove the folders of these keys. Only folder names come to the driver, a batch at a time."""
    jvm, conf = gone.sparkSession._jvm, gone.sparkSession.sparkContext._jsc.hadoopConfiguration()
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in gone.select(*[F.col(k).cast("string") for k in keys]).toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *[escape(k, row[k]) for k in keys]]))
        folder.getFileSystem(conf).delete(folder, True)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Update or insert on the business key; `keep` columns never change once set.

    `updates` must hold one row per key. `upsert_action` says what happened.
    """
    t, u = target.alias("t"), updates.alias("u")
    on = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]
    joined = t.join(u, on, "full_outer")
    in_target, in_updates = F.col(f"t.{keys[0]}").isNotNull(), F.col(f"u.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys or c in keep:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"u.{c}")).alias(c)
        return F.when(in_updates, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    action = F.when(in_target & in_updates, "UPDATED").when(in_updates, "INSERTED").otherwise("KEPT")
    return joined.select(*[pick(c) for c in target.columns], action.alias("upsert_action"))


WORDS = 8  # 32-bit words of the row hash that enter a set digest: all 256 bits


def digest_sums(row_hash: Column) -> list[Column]:
    """Aggregates of a mergeable, order-free digest: the sum of each hash word."""
    return [F.sum(F.conv(F.substring(row_hash, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"__w{i}")
            for i in range(WORDS)]


def digest_text(*lead: Column) -> Column:
    """SHA-256 over `lead` and the summed words."""
    words = [F.coalesce(F.col(f"__w{i}"), F.lit(0)).cast("string") for i in range(WORDS)]
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in lead], *words), 256)


def set_digest(df: DataFrame, keys: Sequence[str], row_hash: Column, size: Column | None = None) -> DataFrame:
    """One digest per key over all its rows, whatever their order or partition.

    Hash words are summed, so the work is a partial aggregation and no key's
    hashes are ever gathered in one task.
    """
    size = F.lit(0) if size is None else size
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum(size.cast("long")).alias("total_bytes"),
                                *digest_sums(row_hash))
    return agg.select(*keys, "entries", "total_bytes",
                      digest_text(F.col("entries"), F.col("total_bytes")).alias("digest"))


def make_snapshot(df: DataFrame, path: str, content: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(path -> sha256 entries, one-row manifest with a digest over all entries)."""
    entries = df.select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("sha256"),
                        F.col(size).alias("bytes"))
    row_hash = F.sha2(F.concat_ws(":", F.col("path").cast("string"), F.col("sha256")), 256)
    return entries, set_digest(entries, [], row_hash, F.col("bytes"))

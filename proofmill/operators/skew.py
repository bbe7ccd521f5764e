"""Ordered and ranked work that never needs a whole key in one task.

A plain `Window.partitionBy(key)` puts every row of a key into one task; when
one key holds a third of the corpus that task never ends. The operators here
range-partition keys and order together, so a hot key spreads over many
partitions, work inside (key, partition), and carry the edges with a second,
tiny window over one summary row per (key, partition). Tables small enough
for one partition, and tables without a hot key, get the plain plan; both plans
give equal rows, null keys included.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.joins import null_safe_join
from ..session import cut

ROWS_PER_BUCKET = 4_000_000
# A key with more than one HOT_SHARE-th of that many rows is hot; a hot key's table is cut into parts of half that size.
HOT_SHARE = 4


def _sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest key); only counts are shuffled."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows, most = counted.agg(F.sum("__n"), F.max("__n")).first()
    return rows or 0, most or 0


class Sequenced:
    """Rows of every key in the total order `order`, in buckets where a key is hot.

    Up to `rows_per_bucket` rows in all, or a quarter of that in the largest key, need none:
    keys are dealt out whole, by hash. Otherwise buckets of about an eighth are range partitions over
    the keys and the whole order, whatever its type and however long a common prefix its values
    share; ties of the whole order share a bucket. `sizing` is a cheap table with as many rows of each key.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 rows_per_bucket: int = ROWS_PER_BUCKET, sizing: DataFrame | None = None) -> None:
        self.keys, self.order = list(keys), list(order)
        rows, most = _sizes(df if sizing is None else sizing, self.keys)
        self.single = rows <= rows_per_bucket or most <= rows_per_bucket // HOT_SHARE
        if self.single:
            self.df = df.withColumn("__b", F.lit(0))
        else:
            buckets = math.ceil(rows / max(1, rows_per_bucket // (2 * HOT_SHARE)))
            ranged = df.repartitionByRange(buckets, *[F.col(c) for c in (*self.keys, *self.order)])
            self.df = cut(ranged.withColumn("__b", F.spark_partition_id()))
        self.local = W.partitionBy(*self.keys, "__b").orderBy(*self.order)
        self.edges = W.partitionBy(*self.keys).orderBy("__b")

    def _carry(self, out: DataFrame, carried: Mapping[str, Column], pick: Mapping[str, Column]) -> DataFrame:
        """Join one summary row per (key, bucket) back; `pick` reads the carried column."""
        summary = self.df.groupBy(*self.keys, "__b").agg(*[c.alias(f"__e_{n}") for n, c in carried.items()])
        summary = summary.select(*self.keys, "__b", *[pick[n].alias(f"__c_{n}") for n in carried])
        return null_safe_join(out, summary, [*self.keys, "__b"], "left")

    def shift(self, columns: Mapping[str, str], step: int = -1) -> DataFrame:
        """Add each `new -> old` column of the previous (-1) or next (+1) row of the key."""
        olds = list(dict.fromkeys(columns.values()))
        row = F.struct(*[F.col(c) for c in olds])
        move = F.lag if step < 0 else F.lead
        out = self.df.withColumn("__p", move(row).over(self.local))
        if not self.single:
            pos = F.struct(*[F.col(c) for c in self.order])
            edge = F.max_by(row, pos) if step < 0 else F.min_by(row, pos)
            out = self._carry(out, {"p": edge}, {"p": move(F.col("__e_p")).over(self.edges)})
            out = out.withColumn("__p", F.coalesce("__p", "__c_p"))
        for new, old in columns.items():
            out = out.withColumn(new, F.col(f"__p.{old}"))
        return out.drop("__p", "__b", "__c_p")

    def fill_next(self, columns: Mapping[str, str]) -> DataFrame:
        """Add `new -> old`: the first non-null value of `old` at or after each row of the key."""
        frame = self.local.rowsBetween(W.currentRow, W.unboundedFollowing)
        out = self.df
        for new, old in columns.items():
            out = out.withColumn(new, F.first(old, ignorenulls=True).over(frame))
        if not self.single:
            pos = F.struct(*[F.col(c) for c in self.order])
            carried = {new: F.min_by(F.col(old), F.when(F.col(old).isNotNull(), pos)) for new, old in columns.items()}
            later = self.edges.rowsBetween(1, W.unboundedFollowing)
            out = self._carry(out, carried, {n: F.first(f"__e_{n}", ignorenulls=True).over(later) for n in columns})
            for new in columns:
                out = out.withColumn(new, F.coalesce(new, f"__c_{new}"))
        return out.drop("__b", *[f"__c_{n}" for n in columns])

    def ordinal(self, name: str = "ordinal") -> DataFrame:
        """1-based position inside the key."""
        out = self.df.withColumn(name, F.row_number().over(self.local).cast("long"))
        if not self.single:
            before = F.sum("__e_n").over(self.edges) - F.col("__e_n")
            out = self._carry(out, {"n": F.count(F.lit(1))}, {"n": before})
            out = out.withColumn(name, F.col(name) + F.col("__c_n"))
        return out.drop("__b", "__c_n")

    def running_sum(self, columns: Mapping[str, str]) -> DataFrame:
        """Inclusive running sums `new -> old` inside the key."""
        frame = self.local.rowsBetween(W.unboundedPreceding, W.currentRow)
        out = self.df
        for new, old in columns.items():
            out = out.withColumn(new, F.sum(old).over(frame))
        if not self.single:
            carried = {new: F.sum(old) for new, old in columns.items()}
            before = {new: F.sum(f"__e_{new}").over(self.edges.rowsBetween(W.unboundedPreceding, -1))
                      for new in columns}
            out = self._carry(out, carried, before)
            for new in columns:
                out = out.withColumn(new, F.coalesce(F.col(new), F.lit(0)) + F.coalesce(F.col(f"__c_{new}"), F.lit(0)))
        return out.drop("__b", *[f"__c_{new}" for new in columns])


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """0-based rank in one total order over the whole table, without a single-task sort.

    Range partitioning on all order columns spreads even long runs of equal
    leading values; the only global step sums one count per partition.
    """
    placed = cut(
        df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        .withColumn("__m", F.monotonically_increasing_id())
    )
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    # one row per shuffle partition: bounded by spark.sql.shuffle.partitions
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__m", "__o", "__part")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
              rows_per_bucket: int = ROWS_PER_BUCKET, sizing: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key: one row per key, one column per prob.

    Up to one bucket of rows the built-in `percentile` is used. Beyond it the
    built-in would hold value maps in memory, so ranks are selected instead:
    without a hot key by one sorted window over the rows, dealt once by key;
    with one, count equal values, rank them inside (key, value bucket),
    and pick the two neighbours of every wanted rank.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    base = (df if sizing is None else sizing).where(F.col(value).isNotNull())
    total, most = _sizes(base, keys)
    if total <= rows_per_bucket:
        found = rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("__q"))
        return found.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])
    if most <= rows_per_bucket // HOT_SHARE:
        w = W.partitionBy(*keys)
        placed = rows.withColumns({"__hi": F.row_number().over(w.orderBy(value)).cast("long"), "__t": F.count(F.lit(1)).over(w)}) \
            .withColumn("__lo", F.col("__hi") - 1)
    else:
        counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
        if not keys:
            counted, base, keys = counted.withColumn("__all", F.lit(0)), base.withColumn("__all", F.lit(0)), ["__all"]
        ranked = Sequenced(counted, keys, [value], rows_per_bucket, sizing=base)
        covered = ranked.running_sum({"__hi": "__n"}).withColumn("__lo", F.col("__hi") - F.col("__n"))
        # from the table that is already written
        totals = ranked.df.groupBy(*keys).agg(F.sum("__n").alias("__t"))
        placed = null_safe_join(covered, totals, keys)
    picks = []
    for name, p in probs.items():
        spot = (F.col("__t") - 1) * F.lit(float(p))
        for side, rank in (("l", F.floor(spot)), ("h", F.ceil(spot))):
            inside = (F.col("__lo") <= rank) & (rank < F.col("__hi"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"__{name}_{side}"))
    picked = placed.groupBy(*keys).agg(F.max("__t").alias("__t"), *picks)
    out = []
    for name, p in probs.items():
        spot = (F.col("__t") - 1) * F.lit(float(p))
        low, high = F.col(f"__{name}_l"), F.col(f"__{name}_h")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*[k for k in keys if k != "__all"], *out)

"""Pluggable measures: DataFrame to observation DataFrame, with an applicability predicate.

Built-in measures are column expressions, so Catalyst sees through them.
`grouped_measure` is the hook for user code whose results merge,
`whole_key_measure` the one for user code that must see every row of a key.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Measure(NamedTuple):
    """A named measure over items it is applicable to, in one of three forms.

    metrics: metric name -> expression over an item's row (one observation a
    row, none where it is null). aggregates: metric name -> (aggregate, value
    expression), over all rows of an item. compute: any plan from items to
    (item_id, metric_name, normalized_value), for what neither can say.
    """
    name: str
    category: str
    formats: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame] | None = None
    applicable: Callable[[], Column] = lambda: F.lit(True)
    metrics: Mapping[str, Column] | None = None
    aggregates: Mapping[str, tuple[Callable[[Column], Column], Column]] | None = None

    def fits(self) -> Column:
        return F.coalesce(F.col("format").isin(*self.formats) & self.applicable(), F.lit(False))


def _observed(name: str, metric: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("engine"), F.lit(metric).alias("metric_name"), value.cast("double").alias("normalized_value"))


def _spread(rows: DataFrame, found: list[Column]) -> DataFrame:
    """One row per observation that has a value."""
    each = F.filter(F.array(*found), lambda o: o["normalized_value"].isNotNull())
    return rows.select("item_id", F.explode(each).alias("o")).select("item_id", "o.*")


class Registry:
    """Named measures on the driver, compiled into as few scans of the items as their forms allow."""

    def __init__(self) -> None:
        self._measures: dict[str, Measure] = {}

    def register(self, measure: Measure) -> None:
        if measure.name in self._measures:
            raise ValueError(f"measure registered twice: {measure.name}")
        if sum(f is not None for f in (measure.compute, measure.metrics, measure.aggregates)) != 1:
            raise ValueError(f"measure {measure.name} needs one of compute, metrics, aggregates")
        self._measures[measure.name] = measure

    def names(self, category: str | None = None, fmt: str | None = None) -> list[str]:
        return [m.name for m in self._measures.values()
                if (category is None or m.category == category) and (fmt is None or fmt in m.formats)]

    def run(self, items: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Observations (item_id, engine, metric_name, normalized_value) of all chosen measures over the items each is applicable to.

        All row metrics are one projection over one scan, all aggregates one
        aggregation over one more; only `compute` measures add a scan each.
        """
        chosen = [self._measures[name] for name in names or self.names()]
        by_row = [_observed(m.name, k, F.when(m.fits(), v)) for m in chosen for k, v in (m.metrics or {}).items()]
        by_item = [(m, k, agg, v) for m in chosen for k, (agg, v) in (m.aggregates or {}).items()]
        parts = [_spread(items, by_row)] if by_row else []
        if by_item:
            wide = items.groupBy("item_id").agg(*[agg(F.when(m.fits(), v)).alias(f"__a{i}") for i, (m, _, agg, v) in enumerate(by_item)])
            parts.append(_spread(wide, [_observed(m.name, k, F.col(f"__a{i}")) for i, (m, k, _, _) in enumerate(by_item)]))
        for m in chosen:
            if m.compute is not None:
                fit = m.compute(items.where(m.fits()))
                parts.append(fit.select("item_id", F.lit(m.name).alias("engine"), "metric_name", F.col("normalized_value").cast("double").alias("normalized_value")))
        if not parts:
            raise ValueError("no measure chosen")
        return reduce(lambda a, b: a.unionByName(b), parts)


def grouped_measure(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                    order: Sequence[str] = ()) -> DataFrame:
    """User function over batches of sorted rows: the frame of each batch holds many keys, whole or partial.

    Partial frames keep any single key from having to fit in memory; `fn` groups
    the frame by key itself, is called once a batch however many keys that has, and must
    return mergeable rows (sums, counts, minima) that the caller aggregates by key.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)
    return (df.sortWithinPartitions(*keys, *order) if order else df).mapInPandas(run, schema)


class KeyFrames:
    """All rows of exactly one key, as pandas frames in order; may be walked several times, one walk after the other.

    Only the frame at hand is in memory. With `keep`, the first walk also
    writes the frames to a nameless scratch file of this task, which later
    walks read. Such a file serves nobody else: a task that is lost takes it
    along and runs again from the shuffle.
    """

    def __init__(self, key: tuple, arriving: Iterator[pd.DataFrame], keep: bool):
        self.key, self.rows = key, 0
        self._keep, self._begun, self._file = keep, False, None
        self._source = self._kept(arriving)

    def _kept(self, arriving: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in arriving:
            self.rows += len(frame)
            if self._keep:
                self._file = self._file or tempfile.TemporaryFile()
                pickle.dump(frame, self._file, pickle.HIGHEST_PROTOCOL)
            yield frame

    def __iter__(self) -> Iterator[pd.DataFrame]:
        if not self._begun:
            self._begun = True
            for frame in self._source:  # not `yield from`: a walk that stops early must leave the rest
                yield frame
            return
        if not self._keep:
            raise RuntimeError("the frames of this key have passed; ask for keep=True to walk them again")
        self._drain()
        self._file.seek(0)
        left = self.rows
        while left:
            frame = pickle.load(self._file)
            left -= len(frame)
            yield frame

    def _drain(self) -> None:
        self._begun = True
        for _ in self._source:
            pass

    def close(self) -> None:
        self._drain()
        if self._file is not None:
            self._file.close()


def _by_key(frames: Iterator[pd.DataFrame], tag: str) -> Iterator[tuple[str, Iterator[pd.DataFrame]]]:
    """Runs of equal `tag` of sorted frames, each as an iterator over the pieces of its frames; a run must be used up before the next is asked for."""
    def pieces() -> Iterator[tuple[str, pd.DataFrame]]:
        for pdf in frames:
            tags = pdf[tag].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], tags[1:] != tags[:-1]))) if len(tags) else np.zeros(0, int)
            bare = pdf.drop(columns=tag)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(tags)], strict=False):
                yield tags[a], bare.iloc[a:b].reset_index(drop=True)

    for value, run in groupby(pieces(), key=lambda p: p[0]):
        yield value, (frame for _, frame in run)


def whole_key_measure(df: DataFrame, keys: Sequence[str], fn: Callable[[KeyFrames], pd.DataFrame | Iterator[pd.DataFrame]], schema: str,
                      order: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """User function over all rows of each key, for results that cannot be merged from parts.

    Rows are shuffled by `keys` and sorted by `keys` and `order` (Spark sorts
    on disk where memory ends), so a key reaches `fn` as an iterator of
    frames of bounded size. `fn` returns a frame or frames of `schema`; what
    it leaves unread is skipped. With `keep` it may walk a key several times.
    A key is one task's work, however large: that is what such a function
    asks for; its memory stays that of a frame, and all other keys are dealt
    out as usual. Null keys are keys like any other.
    """
    names = list(keys)
    tag = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(names)]), {"ignoreNullFields": "false"})
    placed = df.repartition(*[F.col(k) for k in names]).sortWithinPartitions(*names, *order).withColumn("__tag", tag)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, pieces in _by_key(frames, "__tag"):
            first = next(pieces)
            held = KeyFrames(tuple(first[k].iloc[0] for k in names), chain([first], pieces), keep)
            try:
                made = fn(held)
                yield from [made] if isinstance(made, pd.DataFrame) else made
            finally:
                held.close()

    return placed.mapInPandas(run, schema)


def order_statistics(frames: KeyFrames, value: Callable[[pd.DataFrame], np.ndarray], ranks: Callable[[int], Sequence[int]], cells: int = 4096) -> list[float]:
    """Values of the given ranks (from the number of finite values) among `value` of all rows of a key, in memory of one frame.

    Each walk counts values in equal cells of the interval that still holds
    a rank, until its cell holds one value or few. Needs frames that were kept.
    """
    def finite() -> Iterator[np.ndarray]:
        for pdf in frames:
            v = np.asarray(value(pdf), float)
            yield v[np.isfinite(v)]

    n, low, high = 0, np.inf, -np.inf
    for v in finite():
        if len(v):
            n, low, high = n + len(v), min(low, v.min()), max(high, v.max())
    out = []
    for rank in ranks(n) if n else ():
        a, b, below, inside = low, high, 0, n
        while a < b and inside > cells:
            edges = np.unique(np.linspace(a, b, cells + 1))
            counts = np.zeros(len(edges), np.int64)
            for v in finite():
                v = v[(v >= a) & (v <= b)]
                counts += np.bincount(np.searchsorted(edges, v, side="right") - 1, minlength=len(edges))
            ahead = below + np.cumsum(counts)
            cell = int(np.searchsorted(ahead, rank, side="right"))
            below, inside = int(ahead[cell] - counts[cell]), int(counts[cell])
            # the cell is [edge, next edge); the largest value below the next edge closes it
            a, b = edges[cell], np.nextafter(edges[cell + 1], -np.inf) if cell + 1 < len(edges) else edges[cell]
        if a == b:
            out.append(float(a))
            continue
        rest = np.sort(np.concatenate([v[(v >= a) & (v <= b)] for v in finite()]))
        out.append(float(rest[rank - below]))
    return out

"""Joins whose keys may be null: a null key is a group like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where null equals null; keys come from the left. Without keys: `right` is one row for all."""
    if not keys:
        return left.join(F.broadcast(right), how="left" if how == "left" else "cross")
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])

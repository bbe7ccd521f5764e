"""Digest trees over keyed records: one root for a set, and where two sets differ from few digests.

Records are dealt to parts by a prefix of their key's hash, so two sets deal
alike without knowing of each other, whatever their order or partitions, and
parts are of like size whatever the keys. A part's digest is the hash of its
sorted record hashes, a node's that of its sixteen children's digests: unlike
a sum of hash words, none can be kept while a record changes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

PART_ROWS = 1_000


class DigestTree(NamedTuple):
    """levels[k]: (node, digest, entries) of all nodes with a prefix of k hex digits; records: (keys, path, content, copies)."""
    keys: list[str]
    depth: int
    levels: list[DataFrame]
    records: DataFrame

    def root(self) -> str | None:
        row = self.levels[0].select("digest").first()
        return row[0] if row else None


def framed_text(columns: Sequence[Column]) -> Column:
    """Columns as one text that no other columns give: `-` for null, else length, colon, text."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def depth_for(rows: int, part_rows: int = PART_ROWS) -> int:
    """Hex digits after which parts hold about `part_rows` records."""
    return max(0, math.ceil(math.log(max(rows, 1) / part_rows, 16)))


def _hashed(parts: DataFrame, node: Column, order: Sequence[str], text: str) -> DataFrame:
    members = F.array_sort(F.collect_list(F.struct(*order, "entries")))
    listed = parts.groupBy(node.alias("node")).agg(members.alias("m"), F.sum("entries").alias("entries"))
    return listed.select("node", F.sha2(F.array_join(F.transform("m", lambda x: x[text]), ""), 256).alias("digest"), "entries")


def digest_tree(df: DataFrame, keys: Sequence[str], content: Sequence[str], depth: int | None = None, part_rows: int = PART_ROWS) -> DigestTree:
    """The tree over all records of `df`. Two trees compare if their depth is the same; without one it follows the number of rows.

    Equal records count as copies of one; null keys are keys. What a task
    gathers is one part, or the sixteen children of a node.
    """
    keys = list(keys)
    depth = depth_for(df.count(), part_rows) if depth is None else depth
    path = F.sha2(framed_text([F.col(k) for k in keys]), 256)
    body = F.sha2(framed_text([F.col(k) for k in keys] + [F.col(c) for c in content]), 256)
    hashed = df.select(*keys, path.alias("path"), body.alias("content"))
    records = cut(hashed.groupBy("path", "content").agg(*[F.first(k).alias(k) for k in keys], F.count(F.lit(1)).alias("entries")))
    marked = records.withColumn("line", F.concat("path", F.lit(":"), "content", F.lit("*"), F.col("entries").cast("string"), F.lit(";")))
    levels = [cut(_hashed(marked, F.substring("path", 1, depth), ["path", "content", "line"], "line"))]
    for level in range(depth - 1, -1, -1):
        below = levels[0].withColumnRenamed("node", "child")
        levels.insert(0, cut(_hashed(below.withColumn("line", F.concat("child", F.lit(":"), "digest", F.lit(";"))), F.substring("child", 1, level), ["child", "line"], "line")))
    return DigestTree(keys, depth, levels, records)


def differing_parts(a: DigestTree, b: DigestTree) -> tuple[DataFrame, int]:
    """(parts whose digests differ: node, number of digests compared). Only children of differing nodes are looked at."""
    if a.depth != b.depth:
        raise ValueError(f"trees of depth {a.depth} and {b.depth} do not compare")
    compared, open_ = 0, None
    for level in range(a.depth + 1):
        x, y = a.levels[level].select("node", "digest"), b.levels[level].select("node", F.col("digest").alias("other"))
        if open_ is not None:
            parent = F.substring("node", 1, level - 1)
            x, y = (t.withColumn("__p", parent).join(open_.withColumnRenamed("node", "__p"), "__p", "left_semi").drop("__p") for t in (x, y))
        both = cut(x.join(y, "node", "full_outer").select("node", F.col("digest").eqNullSafe(F.col("other")).alias("same")))
        compared += both.count()
        open_ = cut(both.where("not same").select("node"))
    return open_, compared


def tree_difference(a: DigestTree, b: DigestTree) -> DataFrame:
    """Keys whose records differ: (keys, kind) with REMOVED (only in a), ADDED (only in b) or CHANGED. Records of equal parts are not read against each other."""
    parts, _ = differing_parts(a, b)

    def inside(t: DigestTree, name: str) -> DataFrame:
        some = t.records.withColumn("node", F.substring("path", 1, t.depth)).join(parts, "node", "left_semi")
        lines = F.array_sort(F.collect_list(F.struct("content", "entries")))
        return some.groupBy("path").agg(*[F.first(k).alias(f"{k}_{name}") for k in t.keys], F.sha2(F.to_json(lines), 256).alias(f"all_{name}"))

    both = inside(a, "a").join(inside(b, "b"), "path", "full_outer").where(~F.col("all_a").eqNullSafe(F.col("all_b")))
    kind = F.when(F.col("all_b").isNull(), "REMOVED").when(F.col("all_a").isNull(), "ADDED").otherwise("CHANGED")
    return both.select(*[F.when(F.col("all_a").isNull(), F.col(f"{k}_b")).otherwise(F.col(f"{k}_a")).alias(k) for k in a.keys], kind.alias("kind"))

"""Joins on keys: roll-outs, duplicates, clusters, integrity checks, as-of, boxes, remapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..session import cut
from .skew import Sequenced, global_rank


def pair_totals(df: DataFrame, keys: Sequence[str], value: str, id_col: str) -> DataFrame:
    """Count and totals over all pairs inside each key, without forming a pair.

    Sorted position gives the summed absolute difference, first and second
    moments give the summed product, so the work stays linear in the rows.
    """
    placed = Sequenced(df, keys, [value, id_col]).ordinal("__i")
    n = F.count(F.lit(1))
    sized = placed.groupBy(*keys).agg(
        n.alias("items"), F.sum(F.col("__i") * F.col(value)).alias("__iv"),
        F.sum(value).alias("__v"), F.sum(F.col(value) * F.col(value)).alias("__vv"))
    m = F.col("items")
    return sized.select(
        *keys, "items", F.expr("items * (items - 1) div 2").alias("pairs"),
        (2 * F.col("__iv") - (m + 1) * F.col("__v")).alias("abs_diff_sum"),
        ((F.col("__v") * F.col("__v") - F.col("__vv")) / 2).alias("product_sum"))


def duplicate_links(df: DataFrame, id_col: str, digest: str) -> DataFrame:
    """Equal digests as links from the first item of each group to every other member.

    An equal-content group of size n has n-1 links; the relation is its closure,
    so nothing is lost and a group holding a third of the corpus stays linear.
    """
    groups = df.groupBy(digest).agg(F.min(id_col).alias("item_a"), F.count(F.lit(1)).alias("group_size")) \
        .where(F.col("group_size") > 1)
    return df.join(groups, digest).where(F.col(id_col) > F.col("item_a")).select(
        "item_a", F.col(id_col).alias("item_b"), "group_size", F.lit("EXACT_BITSTREAM").alias("relation_kind"))


def classify_match(digest_equal: Column, matches: Column, inlier_ratio: Column, distance: Column,
                   aspect_delta: Column, texture: Column) -> Column:
    """Exact, then geometry, then low-frequency similarity, else NULL."""
    return (
        F.when(digest_equal, "EXACT_BITSTREAM")
        .when((matches >= 12) & (inlier_ratio >= 0.35), "LIKELY_DERIVATIVE")
        .when((distance <= 3) & (aspect_delta <= 0.015) & (texture >= 8.0), "POSSIBLE_DERIVATIVE")
    )


def shared_key_clusters(df: DataFrame, id_col: str, keys: Sequence[str], minimum: int = 2) -> DataFrame:
    """Items sharing all key values (any non-empty), numbered by their first member."""
    any_set = F.concat(*[F.coalesce(F.trim(k), F.lit("")) for k in keys]) != ""
    clusters = df.where(any_set).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.min(id_col).alias("first_member"),
        F.max(id_col).alias("last_member")).where(F.col("members") >= minimum)
    ranked = global_rank(clusters, ["first_member"], "cluster_no")
    return ranked.withColumn("cluster_id", F.format_string("CAM-CLUSTER-%03d", F.col("cluster_no") + 1)).drop("cluster_no")


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two versions of the same keyed measurement side by side, unmatched rows kept."""
    left = a.select(*keys, F.col(value).alias("value_a"))
    right = b.select(*keys, F.col(value).alias("value_b"))
    return left.join(right, list(keys), "full_outer")


STRIPS = 8
DEEPEST = 16


def _strip(cuts: Column, value: Column) -> Column:
    """Number of the strip that holds `value`: how many cuts are not above it."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def _split_tiles(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """For every crowded tile its better axis, the cuts on it, and whether cutting halves the work at least.

    Cuts are quantiles of the boxes' low corners. The work of an axis is
    counted, not guessed: per strip the boxes of both sides that reach into
    it, multiplied, summed over strips.
    """
    shares = [i / STRIPS for i in range(1, STRIPS)]
    cuts = rows.join(crowded, ["item", "tile"]).groupBy("item", "tile").agg(
        *[F.percentile_approx(F.col(f"box.{a}1"), shares).alias(f"cuts_{a}") for a in "xy"], F.first("p").alias("p"), F.first("t").alias("t"))
    placed = rows.join(cuts, ["item", "tile"])
    for a in "xy":
        placed = placed.withColumn(f"low_{a}", _strip(F.col(f"cuts_{a}"), F.col(f"box.{a}1"))).withColumn(f"high_{a}", _strip(F.col(f"cuts_{a}"), F.col(f"box.{a}2")))
    inside = {(a, i, s): F.count_if((F.col(f"low_{a}") <= i) & (F.col(f"high_{a}") >= i) & (F.col("predicted") == s)).cast("double")
              for a in "xy" for i in range(STRIPS) for s in (True, False)}
    work = {a: sum((inside[a, i, True] * inside[a, i, False] for i in range(STRIPS)), F.lit(0.0)) for a in "xy"}
    found = placed.groupBy("item", "tile").agg(work["x"].alias("work_x"), work["y"].alias("work_y"),
                                               *[F.first(c).alias(c) for c in ("cuts_x", "cuts_y", "p", "t")])
    by_x = F.col("work_x") <= F.col("work_y")
    return found.select("item", "tile", "p", "t", by_x.alias("by_x"), F.when(by_x, F.col("cuts_x")).otherwise(F.col("cuts_y")).alias("cuts"),
                        (2 * F.least("work_x", "work_y") <= F.col("p") * F.col("t")).alias("split"))


def _into_strips(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes of split tiles, once in every strip that they reach into, with the strip's bounds."""
    by_x, i, cuts = F.col("by_x"), F.col("strip"), F.col("cuts")
    low, high = F.when(by_x, F.col("box.x1")).otherwise(F.col("box.y1")), F.when(by_x, F.col("box.x2")).otherwise(F.col("box.y2"))
    out = rows.join(tiles.where("split").select("item", "tile", "by_x", "cuts"), ["item", "tile"]) \
        .withColumn("strip", F.explode(F.sequence(_strip(cuts, low), _strip(cuts, high))))
    begin, end = F.get(cuts, i - 1), F.get(cuts, i)  # null at the ends: no cut there

    def bound(name: str, mine: Column, value: Column, pick) -> Column:
        return F.when(mine, pick(F.col(name), F.coalesce(value, F.col(name)))).otherwise(F.col(name)).alias(name)

    return out.select("item", (F.col("tile") * STRIPS + i + 1).alias("tile"), "box", "predicted",
                      bound("from_x", by_x, begin, F.greatest), bound("to_x", by_x, end, F.least),
                      bound("from_y", ~by_x, begin, F.greatest), bound("to_y", ~by_x, end, F.least))


def box_matches(pred: DataFrame, truth: DataFrame, threshold: float = 0.3, crowd: int = 1 << 14, block: int = 4096) -> DataFrame:
    """Best overlap of every predicted box with the truth boxes of its item.

    Sort, tile, recurse: an item whose boxes form more than `crowd` pairs is
    cut into strips at quantiles along the axis that saves more, its strips
    along theirs, until tiles hold fewer pairs or cutting no longer halves
    them; tiles follow the boxes' density and sizes, whatever these are. Equal boxes
    are compared once. A pair is scored only in the tile of its intersection's
    low corner, so no pair is scored twice. Boxes that truly lie on top of
    each other stay together and are dealt to tasks in blocks of `block`.

    Both sides carry item and box (x1, y1, x2, y2); pred also id. A box
    without area, with a null or infinite coordinate or a null item overlaps
    nothing; repeated rows of pred are all returned.
    """
    box, inf = F.col("box"), F.lit(float("inf"))
    solid = (box["x1"] < box["x2"]) & (box["y1"] < box["y2"]) & (box["x1"] > -inf) & (box["y1"] > -inf) & (box["x2"] < inf) & (box["y2"] < inf)

    def side(df: DataFrame, predicted: bool) -> DataFrame:
        return df.where(F.col("item").isNotNull() & solid).select("item", "box").distinct().select(
            "item", F.lit(0).cast("long").alias("tile"), "box", F.lit(predicted).alias("predicted"),
            (-inf).alias("from_x"), inf.alias("to_x"), (-inf).alias("from_y"), inf.alias("to_y"))

    rows, leaves = cut(side(pred, True).unionByName(side(truth, False))), []
    for level in range(DEEPEST + 1):
        p, t = F.col("p"), F.col("t")
        tiles = cut(rows.groupBy("item", "tile").agg(F.count_if("predicted").cast("double").alias("p"), F.count_if(~F.col("predicted")).cast("double").alias("t"))
                    .where((p > 0) & (t > 0)))
        crowded = tiles.where(p * t > crowd)
        if level == DEEPEST or crowded.isEmpty():
            leaves.append((rows, tiles))
            break
        judged = cut(_split_tiles(rows, crowded))
        leaves.append((rows, tiles.where(p * t <= crowd).unionByName(judged.where("not split").select("item", "tile", "p", "t"))))
        rows = cut(_into_strips(rows, judged))

    best = None
    for rows, tiles in leaves:
        dealt = rows.join(tiles.select("item", "tile", F.ceil(F.col("p") / block).cast("int").alias("pieces")), ["item", "tile"])
        a = dealt.where("predicted").withColumn("piece", F.pmod(F.xxhash64("box"), F.col("pieces")).cast("int")).drop("predicted", "pieces")
        b = dealt.where("not predicted").select("item", "tile", F.col("box").alias("other"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        x, y = F.greatest(F.col("box.x1"), F.col("other.x1")), F.greatest(F.col("box.y1"), F.col("other.y1"))
        here = (x >= F.col("from_x")) & (x < F.col("to_x")) & (y >= F.col("from_y")) & (y < F.col("to_y"))
        scored = a.join(b, ["item", "tile", "piece"]).where(here).select("item", "box", boxes.box_iou(F.col("box"), F.col("other")).alias("iou"))
        best = scored if best is None else best.unionByName(scored)
    best = best.groupBy("item", "box").agg(F.max("iou").alias("best_iou"), F.count_if(F.col("iou") > threshold).alias("matches"))
    return pred.join(best, ["item", "box"], "left").select(
        "id", "item", F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"),
        F.coalesce("matches", F.lit(0)).cast("long").alias("matches"),
        (F.coalesce("best_iou", F.lit(0.0)) > threshold).alias("matched"))


def integrity_diff(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """MISSING, UNEXPECTED, MALFORMED and MODIFIED keys of two digest lists, one join."""
    e = expected.select(key, F.col(digest).alias("__e"), F.lit(True).alias("__in_e"))
    a = actual.select(key, F.col(digest).alias("__a"), F.lit(True).alias("__in_a"))
    kind = (F.when(F.col("__in_a").isNull(), "MISSING").when(F.col("__in_e").isNull(), "UNEXPECTED")
            .when(~F.coalesce(F.col("__a").rlike("^[0-9a-f]{64}$"), F.lit(False)), "MALFORMED")
            .when(F.col("__a") != F.col("__e"), "MODIFIED"))
    return e.join(a, key, "full_outer").select(key, kind.alias("kind")).where(F.col("kind").isNotNull())


def dangling(children: Mapping[str, tuple[DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Children whose parent is absent, for every named foreign key.

    name -> (child, child id, foreign key, parent, parent key). NULL keys do not count.
    """
    out = None
    for name, (child, cid, fk, parent, pk) in children.items():
        bad = child.where(F.col(fk).isNotNull()).select(F.col(cid).alias("child_id"), F.col(fk).alias("missing_key")) \
            .join(parent.select(F.col(pk).alias("missing_key")), "missing_key", "left_anti") \
            .select(F.lit(name).alias("fk"), "child_id", "missing_key")
        out = bad if out is None else out.unionByName(bad)
    return out


def surrogate_map(df: DataFrame, key: str, start: int) -> DataFrame:
    """old_id -> new_id, dense, in key order."""
    ranked = global_rank(df.select(F.col(key).alias("old_id")).distinct(), ["old_id"], "r")
    return ranked.select("old_id", (F.col("r") + F.lit(start)).alias("new_id"))


def remap(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    m = mapping.withColumnRenamed("old_id", column)
    return df.join(m, column, "left").drop(column).withColumnRenamed("new_id", column)


def remap_array(df: DataFrame, row_id: str, column: str, mapping: DataFrame) -> DataFrame:
    """Rewrite every id inside an array column, order kept, unknown ids dropped."""
    flat = df.select(row_id, F.posexplode(column).alias("pos", "old_id")).join(mapping, "old_id")
    again = flat.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", "new_id"))).alias("pairs"))
    again = again.select(row_id, F.col("pairs.new_id").alias(column))
    return df.drop(column).join(again, row_id, "left")


def newest_after(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_id: str) -> DataFrame:
    """For every left row the newest right row of its key not older than it (left join).

    The newest row of a key serves all its left rows, so one max per key is joined.
    """
    newest = right.groupBy(key).agg(F.max(F.struct(F.col(right_ts).alias("ts"), F.col(right_id).alias("id"))).alias("__n"))
    hit = F.col("__n.ts") >= F.col(left_ts)
    return left.join(newest, key, "left").withColumn("match_id", F.when(hit, F.col("__n.id"))) \
        .withColumn("match_ts", F.when(hit, F.col("__n.ts"))).drop("__n")


def next_after(left: DataFrame, right: DataFrame, key: str, left_ts: str, left_id: str, right_ts: str, right_id: str) -> DataFrame:
    """For every left row the earliest right row of its key at or after it.

    Both sides are merged into one sequence and filled backwards: linear, no range join.
    """
    a = left.select(key, F.col(left_ts).alias("__ts"), F.lit(0).alias("__side"), F.col(left_id).alias("__id"),
                    F.lit(None).cast(right.schema[right_id].dataType).alias("__r"))
    b = right.select(key, F.col(right_ts).alias("__ts"), F.lit(1).alias("__side"), F.col(right_id).alias("__id"),
                     F.col(right_id).alias("__r"))
    merged = Sequenced(a.unionByName(b), [key], ["__ts", "__side", "__id"]).fill_next({"match_id": "__r"})
    return merged.where("__side = 0").select(key, F.col("__id").alias(left_id), "match_id")


def record_diff(pairs: DataFrame, flags: Sequence[str], sizes: Sequence[str]) -> DataFrame:
    """Equality flags and size differences of two records held as structs a and b."""
    return pairs.select(
        "*", *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).alias(f"same_{c}") for c in flags],
        *[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"diff_{c}") for c in sizes])


def unreferenced(pending: DataFrame, path: str, live: DataFrame, live_path: str) -> DataFrame:
    """Pending paths no live item uses, ignoring case."""
    used = live.select(F.lower(live_path).alias("__p"))
    return pending.withColumn("__p", F.lower(path)).join(used, "__p", "left_anti").drop("__p")

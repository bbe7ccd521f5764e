"""Near-duplicate intake notes: SuperMinHash signatures, banding, verification on full sets, star-shaped components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from .bytehash import U, batches, mix, shingle_sets
from .common import keyed

BANDS, ROWS = 32, 5


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m integers per set (all sets non-empty).

    Step j gives every element the value j + r at the j-th place of its own
    random permutation, so the ranks of an element over the m places are
    correlated and no two are alike. A set stops as soon as all its places
    are below the next step: long sets need two or three steps, not m.
    """
    sizes = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    best = np.full(len(sets) * m, np.iinfo(np.int64).max, np.int64)
    order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(elements), 1))
    for j in range(m):
        x = mix(elements + U((j + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        k = j + ((x & U(0xFFFFFF)) * U(m - j) >> U(24)).astype(np.int64)
        rows = np.arange(len(elements))
        place = order[rows, k]
        order[rows, k] = order[:, j]
        np.minimum.at(best, owner * m + place, (x >> U(24)).astype(np.int64) + (j << 40))
        going = best.reshape(-1, m).max(axis=1) >= (j + 1) << 40
        if not going.any():
            break
        if not going.all():
            stay = going[owner]
            if 2 * stay.sum() < len(stay) or j == 0:
                elements, owner, order = elements[stay], owner[stay], order[stay]
    return best.reshape(-1, m)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signatures.reshape(len(signatures), bands, -1).astype(U)
    key = np.broadcast_to(mix(np.arange(bands, dtype=U)), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mix(key * U(0x100000001B3) ^ parts[:, :, k])
    return key.view(np.int64)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: sums of two mixes of its elements."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=U).view(np.int64)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64))


def _signed(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first, texts in batches(pdf["text"].tolist(), 1 << 19):
                sets = shingle_sets(texts, width)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = dict(zip(full, band_keys(superminhash([sets[k] for k in full], BANDS * ROWS)), strict=True)) if full else {}
                digests = [set_digest(s) for s in sets]
                part = pdf.iloc[first:first + len(texts)]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "k1": part["k1"].to_numpy(), "k2": part["k2"].to_numpy(), "n": [len(s) for s in sets],
                                    "d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "keys": [keys.get(k) for k in range(len(sets))]})
    return run


def _sets(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first, texts in batches(pdf["text"].tolist()):
                sets = shingle_sets(texts, width)
                part = pdf.iloc[first:first + len(texts)]
                right = [set_digest(s) == (a, b) for s, a, b in zip(sets, part["d1"].tolist(), part["d2"].tolist(), strict=True)]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "elements": [s.view(np.int64) for s in sets]})[right]
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    both = F.size(F.array_intersect("ea", "eb")).cast("long")
    return joined.select("a", "b", both.alias("both"), (F.size("ea") + F.size("eb")).cast("long").alias("total")) \
        .where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b")


def _fits(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _open_buckets(crowd: DataFrame, parts: DataFrame) -> DataFrame:
    """Bucket members with their component, in buckets that hold more than one component."""
    placed = crowd.join(parts.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = cut(placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key"))
    return cut(placed.join(mixed, "key"))


def _stars(members: DataFrame, rank: Column, percent: int) -> DataFrame:
    """Every member of a bucket with the bucket's pivot, the lowest member by `rank`, where the two are not in one component yet."""
    pivots = cut(members.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "part")).alias("pivot")))
    met = members.join(pivots, "key").where("node <> pivot.node and part <> pivot.part")
    return met.where(_fits("n", "pivot.n", percent)).select(F.greatest("node", "pivot.node").alias("a"), F.least("node", "pivot.node").alias("b")).distinct()


def _next_stars(members: DataFrame, percent: int) -> DataFrame:
    """Stars around the most central member outside the most central member's component."""
    first = cut(members.groupBy("key").agg(F.min(F.struct(-F.col("mass"), "node", "part")).alias("x")).select("key", F.col("x.part").alias("main")))
    return _stars(members.join(first, "key"), F.struct(F.col("part") == F.col("main"), -F.col("mass")), percent)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections between two short lists of sets, as products of membership matrices, `columns` elements at a time."""
    sides = (left, right)
    flat = [np.concatenate(s) for s in sides]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sides]
    for first in range(0, len(shared), columns):
        part = shared[first:first + columns]
        matrix = []
        for side, values, row in zip(sides, flat, rows, strict=True):
            at = np.searchsorted(part, values)
            hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == values)
            m = np.zeros((len(side), len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            matrix.append(m)
        out += matrix[0] @ matrix[1].T
    return out


def _linked(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the two blocks of a cell, one per member and foreign component: enough to join what belongs together."""
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        both = common_counts([np.asarray(x) for x in a["elements"]], [np.asarray(x) for x in b["elements"]])
        total = a["n"].to_numpy()[:, None] + b["n"].to_numpy()[None, :]
        part = b["part"].to_numpy()
        x, y = np.nonzero((100 * both >= percent * (total - both)) & (a["part"].to_numpy()[:, None] != part[None, :]))
        found = pd.DataFrame({"a": a["node"].to_numpy()[x], "b": b["node"].to_numpy()[y], "part": part[y]})
        return found.drop_duplicates(["a", "part"])[["a", "b"]]
    return run


BLOCK = 256


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that still share a bucket: buckets with one most central member are one group, compared in blocks.

    A group's members are dealt into blocks of about BLOCK by rank; a task
    compares two blocks, so neither a group nor its pairs ever are in one place.
    """
    centre = members.groupBy("key").agg(F.min(F.struct(-F.col("mass"), "node")).alias("x")).select("key", F.col("x.node").alias("centre"))
    rows = cut(members.join(cut(centre), "key").select("centre", "node", "n", "part").distinct())
    blocks = cut(rows.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    dealt = rows.join(blocks, "centre").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), F.when(F.col("own") <= k, 0).otherwise(1).alias("side")))
    # a block meets itself as both sides
    placed = dealt.select("centre", "node", "n", "part", "own", F.explode(F.concat(cells, F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))))).alias("c")) \
        .select("centre", "node", "n", "part", "c.*")
    return placed.join(sets, "node").groupBy("centre", "i", "j").applyInPandas(_linked(percent), "a long, b long")


def near_groups(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", shingle: int = 5, percent: int = 80,
                most_turns: int = 4) -> DataFrame:
    """One row per input row: id, n (set size), part (number of its group), component (smallest id in it), and k1, k2 (hashes of id and text).

    1. Each text becomes a set of shingle hashes and a SuperMinHash signature;
       equal sets are one node, however many copies there are.
    2. Nodes that share a band key meet in a bucket. Members are compared
       with one pivot of their bucket, on the full sets, never all with all.
       The first pivot is the member that meets the most others over all its
       buckets, as a rule the text that the others were made from.
    3. While further pivots, from other components, still find links, they
       follow (`most_turns` at most). Then whatever shares a bucket across
       components is compared in full, in blocks of bounded size, so no link
       between texts that share a bucket is lost. This last step is quadratic
       in the texts of one bucket that are near each other but not near enough.
    """
    docs = keyed(evidence.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    id_type = docs.schema["id"].dataType
    signed = docs.withColumn("id", F.col("id").cast("string")).mapInPandas(_signed(shingle), "id string, k1 long, k2 long, n long, d1 long, d2 long, keys array<bigint>")
    rows = cut(signed.withColumn("id", F.col("id").cast(id_type)))
    # one node per distinct set: copies meet here, counted before the shuffle
    nodes = cut(rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.min("k1").alias("k1"), F.max("keys").alias("keys"))
                .withColumn("node", F.monotonically_increasing_id()))
    met = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = cut(met.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    bucketed = cut(met.join(shared, "key"))
    mass = cut(bucketed.groupBy("node").agg(F.sum("c").alias("mass")))
    crowd = cut(bucketed.drop("c").join(mass, "node"))

    needed = mass.select("node").join(nodes.select("node", "k1", "d1", "d2"), "node")
    texts = docs.select("k1", "text").join(needed, "k1").dropDuplicates(["node"])
    sets = cut(texts.select("node", "d1", "d2", "text").mapInPandas(_sets(shingle), "node long, elements array<bigint>"))

    links = cut(_verified(_stars(crowd.withColumn("part", F.col("node")), -F.col("mass"), percent), sets, percent))
    parts = components(links, "a", "b")
    members = _open_buckets(crowd, parts)
    for _ in range(most_turns):
        pairs = cut(_next_stars(members, percent))
        found = cut(_verified(pairs, sets, percent))
        new, compared = found.count(), pairs.count()
        if new:
            links = links.unionByName(found)
            parts = components(links, "a", "b")
            members = _open_buckets(crowd, parts)
        if 20 * new < compared:
            break
    found = cut(_across(members, sets, percent).distinct())
    if not found.isEmpty():
        parts = components(links.unionByName(found), "a", "b")

    named = nodes.select("node", "d1", "d2", "id").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    lowest = named.groupBy("part").agg(F.min("id").alias("component"))
    byset = named.select("d1", "d2", "part").join(lowest, "part").select("d1", "d2", "part", "component")
    out = rows.select("id", "k1", "k2", "n", "d1", "d2").join(byset, ["d1", "d2"], "left")
    return out.select("id", "k1", "k2", "n", "part", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def near_duplicates(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Group of near-equal texts of every record: `id_col`, n_shingles, component_id, kept.

    A text's set holds its distinct `shingle`-word runs (A-Z lowered, words
    between blanks; a shorter text is one run). Two texts are linked when
    100 * common >= `percent` * united, confirmed on the full sets. The band
    keys miss a pair at 0.8 with probability about 3e-6. component_id is the
    smallest id reachable over links, kept tells whether it is the record's own.

    Null, empty and blank texts have no set, are linked with nothing and are
    kept. Equal texts are linked. Rows with one id and several texts are
    handled as texts; a null id gets the group's id and is kept only where
    no row of the group has one. Repeated rows give repeated rows; extra
    columns are ignored; an empty table gives an empty result.
    """
    groups = near_groups(evidence, id_col, text_col, shingle, percent)
    return groups.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                         F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def representatives(evidence: DataFrame, id_col: str = "evidence_id", text_col: str = "intake_notes", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows, one of each group of near-equal texts: a row with the group's smallest id (of several such rows the lowest hash).

    Texts without words are groups of their own; repeated rows become one.
    """
    groups = near_groups(evidence, id_col, text_col, shingle, percent)
    me = F.struct("k1", "k2")
    lone = groups.where("n = 0").select("k1", "k2")
    chosen = groups.where("n > 0").where(F.col("id").eqNullSafe(F.col("component"))).groupBy("part").agg(F.min(me).alias("me")).select("me.k1", "me.k2")
    rows = keyed(evidence.select(F.struct("*").alias("__row"), F.col(id_col).alias("__i"), F.col(text_col).alias("__t")), "__i", "__t")
    return rows.join(chosen.unionByName(lone).distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("__row.*")

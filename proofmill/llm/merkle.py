"""Merkle manifests of evidence records: one hash tree per case, one over the cases, proofs by slot pivot."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

MOST_SLOTS = 16
FIELDS = ("evidence_id", "source_platform", "case_id", "file_size", "intake_notes")
SIBLINGS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' texts, one after another; null parts are left out."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def framed(value: Column) -> Column:
    """A field as hashed: `-` for null, else its text's UTF-8 byte count, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return digest(*[framed(f) for f in fields])


def folded(leaf: Column, siblings: Column) -> Column:
    """Root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def positions(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """`rows` with pos (0-based, inside its tree by `order`) and n (rows of the tree).

    One range sort over trees and order together, so that a large tree spreads
    over many partitions; what a partition holds of a tree is one summary row.
    """
    placed = cut(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33).alias("__part")
    pieces = placed.groupBy(tree, part).agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(tree).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(tree, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
                           F.sum("__n").over(W.partitionBy(tree)).alias("n"))
    found = placed.withColumn("__part", F.shiftright("__m", 33)).join(pieces, [tree, "__part"])
    return found.withColumn("pos", F.col("__m") + F.col("__shift")).drop("__m", "__part", "__shift")


def _joined(nodes: Sequence[str]) -> str:
    return f"concat({', '.join(['\'\'', *[f"coalesce({c}, '')" for c in nodes]])})"


def _levels(pivot: DataFrame, fanout: int, span: int) -> DataFrame:
    """A pivoted parent with the hashes of all nodes between its slots and itself, h{level}_{node}, and the nodes n{level} its tree has on each level."""
    slots = fanout ** span
    rows = pivot.selectExpr("*", "n AS n0", *[f"s{j}.hash AS h0_{j}" for j in range(slots)])
    for t in range(1, span + 1):
        below = f"n{t - 1}"
        nodes = []
        for j in range(slots // fanout ** t):
            children = [f"h{t - 1}_{j * fanout + k}" for k in range(fanout)]
            # a tree that is down to one node keeps it; a run that is short of nodes is hashed as it is
            nodes.append(f"CASE WHEN {children[0]} IS NULL THEN NULL WHEN {below} > 1 THEN sha2({_joined(children)}, 256) ELSE {children[0]} END AS h{t}_{j}")
        rows = rows.selectExpr("*", f"({below} + {fanout - 1}) div {fanout} AS n{t}", *nodes)
    return rows


def _siblings(slot: int, fanout: int, span: int) -> str:
    """Siblings of a slot's node on each level of a pivot: the other columns of its run, before and after its own."""
    out = []
    for t in range(span):
        own = slot // fanout ** t
        first = own - own % fanout
        left, right = ([f"h{t}_{k}" for k in nodes] for nodes in (range(first, own), range(own + 1, first + fanout)))
        out.append(f"IF(n{t} > 1, named_struct('left', {_joined(left)}, 'right', {_joined(right)}), NULL)")
    return f"array_compact(array({', '.join(out)}))"


def climb(nodes: DataFrame, fanout: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Roots of all trees, and the way back down.

    `nodes`: tree, pos, n, hash, item (a struct that the leaves carry). Each
    pass is one slot pivot: conditional aggregates spread the children of a
    node `span` levels up into fanout ** span columns, from which the levels
    between are hashed by concatenation. The second result takes (tree,
    siblings, and any other columns) of the roots and returns (item, siblings,
    the other columns) of the leaves: a node's siblings are the columns of its
    run without its own, followed by those of its parent. No pass needs more
    than one parent in memory.
    """
    span = 1
    while fanout ** (span + 1) <= MOST_SLOTS:
        span += 1
    slots = fanout ** span
    most = nodes.agg(F.max("n")).first()[0] or 0
    pivots: list[DataFrame] = []
    level = nodes.select("tree", "pos", "n", F.struct("hash", "item").alias("node"))
    while most > 1:
        parent, slot = F.floor(F.col("pos") / slots).cast("long"), F.col("pos") % slots
        spread = [F.expr(f"max(CASE WHEN slot = {j} THEN node END) AS s{j}") for j in range(slots)]
        pivot = cut(level.withColumns({"slot": slot, "pos": parent}).groupBy("tree", "pos").agg(F.max("n").alias("n"), *spread))
        pivots.append(pivot)
        up = _levels(pivot, fanout, span)
        level = up.select("tree", "pos", F.col(f"n{span}").alias("n"), F.struct(F.col(f"h{span}_0").alias("hash")).alias("node"))
        most = -(-most // slots)

    def down(above: DataFrame) -> DataFrame:
        others = [c for c in above.columns if c not in ("tree", "siblings")]
        if not pivots:
            return level.join(above, "tree").select("node.item", "siblings", *others)
        rows = above.withColumn("pos", F.lit(0).cast("long"))
        for k in range(len(pivots) - 1, -1, -1):
            both = _levels(pivots[k], fanout, span).join(rows, ["tree", "pos"])
            children = ", ".join(f"IF(s{j} IS NOT NULL, named_struct('pos', pos * {slots} + {j}, 'item', {'0' if k else f's{j}.item'}, "
                                 f"'siblings', concat({_siblings(j, fanout, span)}, siblings)), NULL)" for j in range(slots))
            each = both.selectExpr("tree", *others, f"explode(array_compact(array({children}))) AS c")
            rows = each.select("tree", "c.pos", "c.siblings", *others) if k else each.select("c.item", "c.siblings", *others)
        return rows

    return level.select("tree", F.col("node.hash").alias("hash")), down


def merkle_manifest(evidence: DataFrame, id_col: str = "evidence_id", tree_col: str = "case_id", fields: Sequence[str] = FIELDS,
                    presented: Mapping[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """Every evidence record with its leaf hash, the root of its case, the root of all cases, and the proof from one to the other.

    The leaf hashes `fields` (each as `-` if null, else byte count, colon,
    text). Leaves of a case (`tree_col`) ascend by `id_col`; while a case has
    several nodes, every `fanout` consecutive ones become the hash of their
    hex digests, a last run of fewer likewise. What remains is the case's
    subroot, a single leaf itself. Subroots, ordered by case (null first, then
    by the bytes of its text), make the root in the same way.

    `presented` names fields as they are found at verification (columns over
    `evidence`); others are taken as recorded. The root is recomputed from the
    presented leaf and the recorded siblings.

    Returns one row per input row: `id_col`, leaf, subroot, root, siblings
    (array of left, right: the digests of the run before and after its own,
    from the leaf up), folded_root, verified (folded_root equals root).

    Leaves meet only in groups of at most 16 consecutive ones; a case of any
    size spreads over all tasks, and texts are hashed where they are read and
    never shuffled. Null ids come first in their case and null cases form one;
    repeated rows are leaves of their own with equal hashes. Extra columns do
    not matter. An empty table gives an empty table.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    seen = [(presented or {}).get(c, F.col(c)) for c in fields]
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("-"))  # "-" sorts before "="
    leaves = evidence.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf_hash([F.col(c) for c in fields]).alias("hash"),
                             (leaf_hash(seen) if presented else F.lit(None).cast("string")).alias("found"))
    written = cut(leaves.withColumn("found", F.when(F.col("found") != F.col("hash"), F.col("found"))))
    item = F.struct("id", F.col("hash").alias("leaf"), "found").alias("item")
    roots, to_leaves = climb(positions(written, "tree", ["id", "hash", "found"]).select("tree", "pos", "n", "hash", item), fanout)
    subroots = cut(roots)
    one = subroots.select(F.lit("").alias("all"), F.col("tree").alias("key"), "hash")
    tops, to_subroots = climb(positions(one, "all", ["key"]).select(F.col("all").alias("tree"), "pos", "n", "hash", F.struct("key", "hash").alias("item")), fanout)
    above = to_subroots(tops.select("tree", F.array().cast(SIBLINGS).alias("siblings"), F.col("hash").alias("root")))
    rows = to_leaves(above.select(F.col("item.key").alias("tree"), "siblings", F.col("item.hash").alias("subroot"), "root"))
    out = rows.select(F.col("item.id").alias(id_col), F.col("item.leaf").alias("leaf"), "subroot", "root", "siblings",
                      folded(F.coalesce("item.found", "item.leaf"), F.col("siblings")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

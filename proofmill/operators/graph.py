"""Graph and region jobs: build, neighbourhood, layers, components, regions, lineage walks.

Every step is a join or an aggregate over edge rows; no adjacency list is ever
gathered. Iterations write their state to the shared checkpoint folder, so a
lost executor costs one round, and plans stay short.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import row_count
from ..session import cut, drop_step, lean

# Edges of a large graph get their numbers in so many passes, each with the names of one part.
SLICES = 4
SLICED_FROM = 4_000_000


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def build_graph(nodes: Sequence[DataFrame], edges: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) once per id; edges (source, target, type) once each, both ends present."""
    n = union(nodes).groupBy("id").agg(F.min(F.struct("type", "label")).alias("__n")).select("id", "__n.*")
    return n, induced(union(edges).distinct(), n)


def numbered_graph(nodes: Sequence[DataFrame], edges: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The graph of `build_graph` written once for traversals, by numbers: nodes (id, name, type, label), edges (source, target, type).

    The ends are checked by the same joins that look up their numbers, so
    every later step meets on eight bytes and not on names. Many edges are
    looked up by parts of the names, one after the other, so that the disk
    never holds all of them in transit.
    """
    with lean(nodes[0].sparkSession):
        n = cut(build_graph(nodes, edges)[0].withColumnRenamed("id", "name").withColumn("id", F.monotonically_increasing_id()))
        named = cut(union(edges))
        slices = range(SLICES if named.count() > SLICED_FROM else 1)

        def part(rows: DataFrame, name: str, k: int) -> DataFrame:
            return rows.where(F.pmod(F.xxhash64(name), F.lit(len(slices))) == k)

        def numbers(name: str, number: str, k: int) -> DataFrame:
            return part(n, "name", k).select(F.col("name").alias(name), F.col("id").alias(number)).hint("shuffle_hash")

        half = union([cut(part(named, "source", k).join(numbers("source", "s", k), "source").select("s", "target", "type")) for k in slices])
        drop_step(named)
        # equal edges have one target, so they are in one part
        whole = union([cut(part(half, "target", k).join(numbers("target", "t", k), "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "type").distinct())
                       for k in slices])
        drop_step(half)
    return n, whole


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both in `nodes`.

    A node is one row, so each partition's ids make an even hash table; the
    edges, many times as many, need no sorting.
    """
    ids = nodes.select("id").distinct().hint("shuffle_hash")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi") \
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def lineage_edges(relations: DataFrame, prefix: str = "ev:") -> DataFrame:
    """Item pairs as edges: from the derived item to its parent when one is confirmed, else a to b by kind.

    relations: item_a, item_b, parent_id, relation_kind.
    """
    a, b, parent = F.col("item_a"), F.col("item_b"), F.col("parent_id")
    known = F.coalesce((parent == a) | (parent == b), F.lit(False))
    flip = F.coalesce(parent == a, F.lit(False))
    end = lambda c: F.concat(F.lit(prefix), c.cast("string"))
    return relations.select(
        F.when(flip, end(b)).otherwise(end(a)).alias("source"), F.when(flip, end(a)).otherwise(end(b)).alias("target"),
        F.when(known, "DERIVED_FROM").otherwise(F.upper(F.coalesce("relation_kind", F.lit("CANDIDATE_LINEAGE")))).alias("type"))


def relation_type(raw: Column) -> Column:
    """One spelling per observation relation; blank names give NULL (no edge)."""
    t = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(t.isin("SUPPORTING", "SUPPORTS"), "SUPPORTS").when(t.isin("CONTRASTING", "CONTRADICTS"), "CONTRADICTS").when(t != "", t)


def neighbourhood(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of one type with their direct neighbours, and the edges among them."""
    seed = nodes.where(F.col("type") == kind).select("id")
    out = edges.join(seed.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    back = edges.join(seed.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    keep = cut(nodes.join(union([seed, out, back]).distinct(), "id", "left_semi"))
    return keep, induced(edges, keep)


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Connected components of an undirected edge list: (node, component = lowest node in it).

    Alternating large-star and small-star (Kiveris et al., 2014): every round
    links nodes to the lowest neighbour, and the edge set shrinks to one star
    per component in a logarithmic number of rounds. Minima combine before
    the shuffle, so a hub with a third of all edges sends one value per task.
    Stars pack into small files; joins on them are merged, so that no table of
    edges is unpacked in the driver.
    """
    a, b = F.col(src), F.col(dst)
    star = cut(edges.where(a != b).select(F.greatest(a, b).alias("c"), F.least(a, b).alias("p")).distinct())
    while True:
        # large star: every higher neighbour of a node moves to the lowest one around it
        both = star.select(F.col("c").alias("u"), F.col("p").alias("v")).unionByName(star.select(F.col("p").alias("u"), F.col("c").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("c"), F.col("m").alias("p")).distinct()
        # small star: every node and its lower neighbours move to the lowest of them
        least = large.groupBy("c").agg(F.min("p").alias("m"))
        small = large.join(least.hint("merge"), "c").where("p <> m").select(F.col("p").alias("c"), F.col("m").alias("p")) \
            .unionByName(least.select("c", F.col("m").alias("p"))).distinct()
        last, star = star, cut(small)
        drop_step(last)
        # done when every child has one parent and no parent is itself a child
        two = star.groupBy("c").agg(row_count().alias("n")).where("n > 1").select("c")
        inner = star.select(F.col("p").alias("c")).join(star.select("c").hint("merge"), "c", "left_semi")
        if two.unionByName(inner).isEmpty():
            break
    return star.select(F.col("c").alias("node"), F.col("p").alias("component")) \
        .unionByName(star.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())


def _chains(state: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that only wait for the end of a chain: (id, head, floor, steps).

    A node whose one open predecessor has no other successor follows it: its
    layer is the larger of `floor` (what released predecessors pushed it to)
    and the head's layer plus `steps`. Heads are found by pointer doubling,
    in a logarithmic number of rounds; such laws compose. Nodes of closed
    rings have no head and are left out.
    """
    single = links.groupBy("source").agg(row_count().alias("n")).where("n = 1").select("source")
    waiting = state.where("open = 1").select(F.col("id").alias("target"), F.col("layer").alias("floor"))
    inner = cut(links.join(single, "source", "left_semi").join(waiting, "target").select(F.col("target").alias("id"), F.col("source").alias("head"), "floor"))
    ids = inner.select(F.col("id").alias("head"), F.lit(False).alias("ended"))
    chain = cut(inner.join(ids, "head", "left").select("id", "head", "floor", F.lit(1).alias("steps"), F.coalesce("ended", F.lit(True)).alias("ended")))
    drop_step(inner)
    rows, ended = chain.agg(row_count(), F.count_if("ended")).first()
    while ended < rows:
        ahead = chain.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("floor").alias("f"), F.col("steps").alias("s"), F.col("ended").alias("e"))
        open_ = chain.where("not ended").join(ahead, "head").select(
            "id", F.col("next").alias("head"), F.greatest("floor", F.col("f") + F.col("steps")).alias("floor"), (F.col("steps") + F.col("s")).alias("steps"), F.col("e").alias("ended"))
        last, chain = chain, cut(chain.where("ended").unionByName(open_))
        drop_step(last)
        before, ended = ended, chain.agg(F.count_if("ended")).first()[0]
        if ended == before:
            break
    return chain.where("ended").drop("ended")


def _peeled(state: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Release all nodes that can go without breaking a cycle: (id, layer) of these, and the state of the others. Chains count as one node."""
    chain = _chains(state, links)
    heads = chain.select(F.col("id").alias("source"), "head", "floor", "steps")
    ways = cut(links.join(chain.select(F.col("id").alias("target")), "target", "left_anti").join(heads, "source", "left").select(
        F.coalesce("head", "source").alias("head"), "target", F.coalesce("floor", F.lit(0)).alias("floor"), F.coalesce("steps", F.lit(0)).alias("steps")))
    left, gone, steps = state.join(chain.select("id"), "id", "left_anti"), [], []
    while True:
        if steps:  # those released are kept, the others are in the next step
            ready = cut(left.where("open = 0").select("id", "layer"))
        else:
            ready = left.where("open = 0").select("id", "layer")
        gone.append(ready)
        source = F.greatest("floor", F.col("layer") + F.col("steps"))
        pushed = ways.join(ready.withColumnRenamed("id", "head"), "head").groupBy(F.col("target").alias("id")).agg(row_count().alias("less"), (F.max(source) + 1).alias("down"))
        left = cut(left.where("open <> 0").join(pushed, "id", "left").select(
            "id", "kind", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"), F.greatest("layer", F.coalesce("down", F.lit(0))).alias("layer")))
        if steps:
            drop_step(steps[-1])
        steps.append(left)
        if not left.where("open = 0").limit(1).count():
            break
    drop_step(ways)
    released = cut(union(gone))
    for step in gone[1:]:
        drop_step(step)
    behind = chain.join(released.withColumnRenamed("id", "head"), "head").select("id", F.greatest("floor", F.col("layer") + F.col("steps")).alias("layer"))
    out = cut(released.unionByName(behind))
    drop_step(released)
    waiting = state.join(chain.select("id"), "id", "left_semi").join(out.select("id"), "id", "left_anti")
    rest = cut(left.unionByName(waiting))
    for step in (left, chain):
        drop_step(step)
    return out, rest


def layers(nodes: DataFrame, edges: DataFrame, order: Mapping[str, int] | None = None, checked: bool = False) -> DataFrame:
    """Longest-path layer of every node: (id, layer, broke_cycle).

    Nodes without open predecessors leave together and push their successors
    down. Where only cycles remain, the node with the fewest open
    predecessors (then type order, label, id) is released: one per remaining
    weak component, as components cannot influence each other. Numbered nodes
    bring the `name` that decides last. Chains are
    contracted before every pass, so a long path, or a ring once it is broken,
    takes a logarithmic number of rounds and not one per node. `checked` tells
    that both ends of every edge are known to be in `nodes`; such edges are read
    where they are, and the caller removes them. Steps made here are removed as soon as the next one stands.
    """
    kinds = F.create_map(*[F.lit(x) for kv in (order or {"": 0}).items() for x in kv])
    done: list[DataFrame] = []
    with lean(nodes.sparkSession):
        given = edges if checked else cut(induced(edges.where("source <> target"), nodes).select("source", "target"))
        links = given.where("source <> target").select("source", "target")
        indeg = links.groupBy(F.col("target").alias("id")).agg(row_count().alias("open"))
        names = nodes.select("id", "label", F.col("name" if "name" in nodes.columns else "id").alias("name"))
        state = cut(nodes.select("id", F.coalesce(F.element_at(kinds, F.col("type")), F.lit(99)).alias("kind"))
                    .join(indeg, "id", "left").select("id", "kind", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("layer")))
        while True:
            left, free = state.agg(row_count(), F.count_if(F.col("open") == 0)).first()
            if not left:
                break
            last = (state,) if checked and not done else (state, links)
            if free:
                ready, state = _peeled(state, links)
            else:
                weak = components(links, "source", "target")
                pick = state.join(weak.withColumnRenamed("node", "id"), "id").join(names, "id").groupBy("component") \
                    .agg(F.min(F.struct("open", "kind", "label", "name", "id")).alias("m")).select("m.id")
                ready = cut(state.join(pick, "id", "left_semi").select("id", "layer"))
                drop_step(weak)
                pushed = links.join(ready.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(
                    row_count().alias("less"), (F.max("layer") + 1).alias("down"))
                state = cut(state.join(ready.select("id"), "id", "left_anti").join(pushed, "id", "left").select(
                    "id", "kind", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"), F.greatest("layer", F.coalesce("down", F.lit(0))).alias("layer")))
            done.append(ready.select("id", "layer", F.lit(not free).alias("broke_cycle")))
            links = cut(links.join(state.select(F.col("id").alias("source")), "source", "left_semi").join(state.select(F.col("id").alias("target")), "target", "left_semi")
                        .select("source", "target"))
            for step in last:
                drop_step(step)
        for step in (state,) if checked and not done else (state, links):
            drop_step(step)
    return union(done) if done else nodes.select("id", F.lit(0).alias("layer"), F.lit(False).alias("broke_cycle"))


def grid_regions(flagged: DataFrame, item: str, x: str, y: str, z: str, v: str, minimum: int = 3) -> DataFrame:
    """8-connected regions of flagged cells: size, bounding box, deviation, type by sign.

    Every cell looks for its four later neighbours by an equi-join on position.
    """
    cells = flagged.select(F.col(item).alias("item"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(z).alias("z"), F.col(v).alias("v"))
    cells = cut(cells.withColumn("id", F.struct("item", "y", "x")))
    at = lambda dx, dy: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    near = cells.select("id", "item", "x", "y", F.explode(F.array(at(1, 0), at(-1, 1), at(0, 1), at(1, 1))).alias("o")) \
        .select("item", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("id").alias("other"))
    links = near.join(cells.select("item", "x", "y", "id"), ["item", "x", "y"]).select("other", "id")
    comp = components(links, "other", "id").withColumnRenamed("node", "id")
    placed = cells.join(comp, "id", "left").withColumn("region", F.coalesce("component", "id"))
    out = placed.groupBy("region").agg(
        row_count().alias("cells"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
        F.avg("z").alias("mean_z"), F.max(F.abs("z")).alias("max_z"), F.avg("v").alias("mean_value")).where(F.col("cells") >= minimum)
    return out.select(F.col("region.item").alias("item"), *[c for c in out.columns if c != "region"],
                      F.when(F.col("mean_z") > 0, "ELEVATED").otherwise("ATTENUATED").alias("type"))


def walk(edges: DataFrame, starts: DataFrame, child: str, parent: str, up: bool = True, growth: int = 8) -> DataFrame:
    """All ancestors (or descendants) of the start nodes with their distance: (start, node, depth).

    Pointer doubling: round k joins what is known of distances below 2^k with
    all jumps of exactly 2^k steps, so a chain of n nodes takes log n rounds.
    In a forest there are never more jumps than edges. Where several parents
    make them more than `growth` times as many, the walk goes on from its
    last front by single steps, with the same result. Cycles end by
    themselves; a start is not its own ancestor.
    """
    here, there = (child, parent) if up else (parent, child)
    step = cut(edges.select(F.col(here).alias("node"), F.col(there).alias("next")).where("node is not null and next is not null").distinct())
    own = F.col(starts.columns[0])
    seen = [cut(starts.select(own.alias("start"), own.alias("node"), F.lit(0).alias("depth")).where("start is not null").distinct())]

    def further(front: DataFrame, jumps: DataFrame, by: int) -> DataFrame:
        far = front.join(jumps, "node").groupBy("start", F.col("next").alias("node")).agg((F.min("depth") + by).cast("int").alias("depth"))
        return cut(far.join(union(seen).select("start", "node"), ["start", "node"], "left_anti"))

    jumps, reach, edge_count = step, 1, step.count()
    while jumps.count() <= growth * edge_count:
        new = further(union(seen), jumps, reach)
        if new.isEmpty():
            return union(seen).where("depth > 0")
        seen.append(new)
        reach *= 2
        jumps = cut(jumps.join(jumps.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")).distinct())
    front = union(seen).where(F.col("depth") == reach - 1)
    while True:
        front = further(front, step, 1)
        if front.isEmpty():
            return union(seen).where("depth > 0")
        seen.append(front)

"""Iterative graph jobs against small reference computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofmill.operators import graph as R


def frame(spark, rows, cols):
    return spark.createDataFrame(pd.DataFrame(rows, columns=cols))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(200, k) for k in range(201, 260)] + [(k, k + 1) for k in range(300, 330)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in R.components(frame(spark, edges, ["a", "b"]), "a", "b").collect()}
    assert got == {x: find(x) for x in linked}


def serial_layers(nodes, edges):
    """One node or one ready batch at a time, as a single machine would do it."""
    edges = [(s, t) for s, t in edges if s != t]
    open_in = {n: sum(t == n for _, t in edges) for n in nodes}
    level, seen = {n: 0 for n in nodes}, set()
    while len(seen) < len(nodes):
        batch = [n for n in nodes if n not in seen and open_in[n] == 0]
        if not batch:
            batch = [min((n for n in nodes if n not in seen), key=lambda n: (open_in[n], n))]
        seen.update(batch)
        for s, t in edges:
            if s in batch and t not in seen:
                level[t] = max(level[t], level[s] + 1)
                open_in[t] -= 1
    return level


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_with_cycles(spark, seed):
    rng = np.random.default_rng(seed)
    nodes = [f"n{i:02d}" for i in range(24)]
    edges = sorted({(nodes[a], nodes[b]) for a, b in rng.integers(0, 24, (26, 2))})
    nf = frame(spark, [(n, "CASE", n) for n in nodes], ["id", "type", "label"])
    ef = frame(spark, [(s, t, "E") for s, t in edges], ["source", "target", "type"])
    got = {r.id: r.layer for r in R.layers(nf, ef, {"CASE": 0}).collect()}
    assert got == serial_layers(nodes, edges)


def counted(monkeypatch):
    """Every write of a step, counted."""
    made = []
    plain = R.cut
    monkeypatch.setattr(R, "cut", lambda df: made.append(1) or plain(df))
    return made


def test_layers_of_a_long_ring_take_few_rounds(spark, monkeypatch):
    """The ring breaks at its first node; the others follow in order, found by doubling. A second ring hangs on a path."""
    n = 2_000
    ring = spark.range(n).select(F.format_string("r%05d", "id").alias("source"), F.format_string("r%05d", (F.col("id") + 1) % n).alias("target"))
    tail = [("p0", "p1"), ("p1", "p2"), ("p2", "q0"), ("q0", "q1"), ("q1", "q2"), ("q2", "q0"), ("q2", "z"), ("p0", "z")]
    edges = ring.unionByName(frame(spark, tail, ["source", "target"])).withColumn("type", F.lit("E"))
    nodes = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct().withColumns({"type": F.lit("CASE"), "label": F.col("id")})
    made = counted(monkeypatch)
    got = {r.id: (r.layer, r.broke_cycle) for r in R.layers(nodes, edges, {"CASE": 0}).collect()}
    assert {k: v[0] for k, v in got.items() if k[0] == "r"} == {f"r{i:05d}": i for i in range(n)}
    assert {k: v[0] for k, v in got.items() if k[0] != "r"} == serial_layers(sorted({x for e in tail for x in e}), tail)
    assert sorted(k for k, v in got.items() if v[1]) == ["q0", "r00000"]
    assert len(made) < 60


def test_layers_of_chains_with_side_entries(spark):
    """Chains that join, with entries into their middle and repeated edges, against the serial version."""
    rng = np.random.default_rng(9)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(30)] + [(nodes[35], nodes[12]), (nodes[36], nodes[12]), (nodes[3], nodes[31]), (nodes[31], nodes[32]), (nodes[32], nodes[20]),
                                                            (nodes[20], nodes[33]), (nodes[33], nodes[34]), (nodes[34], nodes[18])]
    edges += [(nodes[a], nodes[b]) for a, b in rng.integers(0, 40, (3, 2))]
    edges = sorted(set(edges))
    nf = frame(spark, [(n, "CASE", n) for n in nodes], ["id", "type", "label"])
    got = {r.id: r.layer for r in R.layers(nf, frame(spark, [(s, t, "E") for s, t in edges], ["source", "target", "type"]), {"CASE": 0}).collect()}
    assert got == serial_layers(nodes, edges)


def nearest(edges, starts):
    out = {}
    for s in starts:
        dist, front = {s: 0}, [s]
        while front:
            front = [b for f in front for a, b in edges if a == f and b not in dist and not dist.update({b: dist[f] + 1})]
        out |= {(s, v): d for v, d in dist.items() if d}
    return out


@pytest.mark.parametrize("growth", [0, 8])
def test_walk_equals_breadth_first(spark, growth):
    """Several parents, cycles, unreachable nodes; doubling alone, and single steps from the first round on."""
    rng = np.random.default_rng(4)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (70, 2))} | {(100 + i, 101 + i) for i in range(21)})
    starts = [0, 5, 100, 110, 999]
    rows = R.walk(frame(spark, edges, ["a", "b"]), frame(spark, [(s,) for s in starts], ["s"]), "a", "b", growth=growth).collect()
    assert {(r.start, r.node): r.depth for r in rows} == nearest(edges, starts) and len(rows) == len({(r.start, r.node) for r in rows})
    down = R.walk(frame(spark, edges, ["a", "b"]), frame(spark, [(121,)], ["s"]), "a", "b", up=False, growth=growth).collect()
    assert {(r.start, r.node): r.depth for r in down} == {(121, 121 - k): k for k in range(1, 22)}


def test_walk_up_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 100_000
    edges = spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    made = counted(monkeypatch)
    out = R.walk(edges, spark.createDataFrame([(n - 1,)], "s long"), "child", "parent")
    assert out.count() == n - 1 and out.where(F.col("node") + F.col("depth") != n - 1).count() == 0
    assert len(made) <= 2 * 18 + 2


def test_build_drops_dangling_and_repeated(spark):
    n = frame(spark, [("a", "CASE", "x"), ("b", "EVIDENCE", "y"), ("a", "CASE", "x")], ["id", "type", "label"])
    e = frame(spark, [("a", "b", "CONTAINS"), ("a", "b", "CONTAINS"), ("a", "z", "CONTAINS")], ["source", "target", "type"])
    nodes, edges = R.build_graph([n], [e])
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("a", "b", "CONTAINS")]


def test_edges_are_checked_without_sorting(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = frame(spark, [(f"n{i}", "CASE", "x") for i in range(9)], ["id", "type", "label"])
        e = frame(spark, [(f"n{i}", f"n{i + 2}", "E") for i in range(9)] * 2, ["source", "target", "type"])
        edges = R.build_graph([n], [e])[1]
        assert "SortMergeJoin" not in edges._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in edges.collect()) == [(f"n{i}", f"n{i + 2}", "E") for i in range(7)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbered_graph_is_the_same_graph(spark):
    """Repeated, dangling and looping edges, nodes named twice; traversals by number give those by name."""
    n = frame(spark, [("a", "CASE", "x"), ("b", "EVIDENCE", "y"), ("a", "CASE", "w"), ("c", "FINDING", "y"), ("d", "EVIDENCE", "x"), ("e", "EVIDENCE", "x")], ["id", "type", "label"])
    e = frame(spark, [("a", "b", "E"), ("a", "b", "E"), ("a", "z", "E"), ("b", "c", "F"), ("c", "c", "F"), ("d", "e", "E"), ("e", "d", "E"), ("e", "d", "F")], ["source", "target", "type"])
    nodes, edges = R.build_graph([n], [e])
    numbered, pairs = R.numbered_graph([n], [e])
    assert dict(numbered.dtypes)["id"] == dict(pairs.dtypes)["source"] == dict(pairs.dtypes)["target"] == "bigint"
    name = {r.id: r.name for r in numbered.collect()}
    assert sorted((r.name, r.type, r.label) for r in numbered.collect()) == sorted(tuple(r) for r in nodes.collect())
    assert sorted((name[r.source], name[r.target], r.type) for r in pairs.collect()) == sorted(tuple(r) for r in edges.collect())
    near, among = R.neighbourhood(numbered, pairs, "FINDING")
    assert sorted(name[r.id] for r in near.collect()) == ["b", "c"] and sorted((name[r.source], name[r.target]) for r in among.collect()) == [("b", "c"), ("c", "c")]
    by_name = sorted(tuple(r) for r in R.layers(nodes, edges, {"CASE": 0}).collect())
    assert sorted((name[r.id], r.layer, r.broke_cycle) for r in R.layers(numbered, pairs, {"CASE": 0}).collect()) == by_name


def test_grid_regions_join_diagonals(spark):
    cells = [(0, 0), (1, 1), (2, 2), (5, 0), (6, 1), (5, 2), (7, 7)]  # two diagonals and a single cell
    df = frame(spark, [("i", x, y, -2.0, 1.0) for x, y in cells], ["item", "x", "y", "z", "v"])
    got = sorted((r.cells, r.x1, r.y1, r.x2, r.y2, r.type) for r in R.grid_regions(df, "item", "x", "y", "z", "v").collect())
    assert got == [(3, 0, 0, 3, 3, "ATTENUATED"), (3, 5, 0, 7, 3, "ATTENUATED")]


def test_walk_stops_on_cycles(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 1)], ["child", "parent"])
    got = {(r.start, r.node, r.depth) for r in R.walk(e, frame(spark, [(1,)], ["s"]), "child", "parent").collect()}
    assert got == {(1, 2, 1), (1, 3, 2)}
    down = {(r.start, r.node) for r in R.walk(e, frame(spark, [(3,)], ["s"]), "child", "parent", up=False).collect()}
    assert down == {(3, 2), (3, 1)}


def test_traversals_leave_no_steps_behind(spark, tmp_path):
    """Beside the numbered graph and the layers themselves no step is left, and the graph of many slices is the same."""
    import os

    from proofmill import session

    n = frame(spark, [(f"n{i:02d}", "CASE", "x") for i in range(40)], ["id", "type", "label"])
    pairs = [(f"n{i:02d}", f"n{j:02d}") for i, j in [(i, i + 1) for i in range(25)] + [(30, 31), (31, 32), (32, 30), (5, 20), (7, 33), (33, 34), (1, 99), (0, 0)]]
    e = frame(spark, [(s, t, "E") for s, t in pairs + pairs[:9]], ["source", "target", "type"])
    found = []
    for most in (R.SLICED_FROM, 0):
        before, folders = R.SLICED_FROM, set(session.STEPS)
        R.SLICED_FROM = most
        try:
            nodes, edges = R.numbered_graph([n], [e])
        finally:
            R.SLICED_FROM = before
        graph = set(session.STEPS) - folders
        assert len(graph) == (2 if most else 1 + R.SLICES)
        out = R.layers(nodes, edges, {"CASE": 0}, checked=True)
        kept = {f.split("/")[-2] for f in out.inputFiles()}
        assert {os.path.basename(s) for s in set(session.STEPS) - folders} == {os.path.basename(s) for s in graph} | kept
        name = {r.id: r.name for r in nodes.collect()}
        assert sorted((name[r.source], name[r.target]) for r in edges.collect()) == sorted(p for p in pairs if p[1] != "n99")
        found.append({name[r.id]: r.layer for r in out.collect()})
    assert found[0] == found[1] == serial_layers([f"n{i:02d}" for i in range(40)], [p for p in pairs if p[1] != "n99"])

"""Groups of detections by nearness in graph and time against all pairs."""

import random
from collections import defaultdict

import pytest

from sentrylake.operators import graph


def pairs(touched, edges, window, radius):
    """Groups by comparing all pairs of events; distances by breadth-first search."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def ball(node):
        seen, layer = {node}, {node}
        for _ in range(radius):
            layer = {m for n in layer for m in near[n]} - seen
            seen |= layer
        return seen

    nodes, times = defaultdict(set), {}
    for event, ts, node in touched:
        if ts is not None and node is not None:
            nodes[event].add((node, ts))
            times[event] = ts
    reach = {n: ball(n) for _, _, n in touched if n is not None}
    group = {e: e for e in nodes}

    def top(e):
        while group[e] != e:
            e = group[e]
        return e

    for a in nodes:
        for b in nodes:
            if a < b and abs(times[a] - times[b]) <= window and any(n in reach[m] for m, _ in nodes[a] for n, _ in nodes[b]):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {e: top(e) for e in nodes}


def made(seed, events=200, nodes=120, span=6_000):
    draw = random.Random(seed)
    edges = [(f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}") for _ in range(nodes)]
    # a hub, and a chain
    edges += [("n0", f"n{i}") for i in range(1, 30)] + [(f"n{i}", f"n{i + 1}") for i in range(90, 100)]
    touched = []
    for e in range(events):
        ts = float(draw.randrange(0, span, 50))
        touched += [(e, ts, f"n{draw.randrange(nodes)}") for _ in range(draw.choice([1, 1, 2, 3]))]
    return touched + [(events, None, "n1"), (events + 1, 5.0, None), touched[0]], edges


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_as_all_pairs(spark, radius):
    touched, edges = made(radius, span=60_000 if radius > 1 else 6_000)
    rows = spark.createDataFrame(touched, "event_id long, ts double, node string")
    out = graph.correlate(rows, 300.0, spark.createDataFrame(edges, "src string, dst string"), radius).collect()
    want = pairs(touched, edges, 300.0, radius)
    got = {r["event_id"]: r["group_id"] for r in out}
    assert len(out) == len(got) and got == want
    assert 1 < len(set(want.values())) < len(want)


def test_window_is_inclusive(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (2, 300.0, "a"), (3, 600.5, "a"), (4, 900.5, "b")], "event_id long, ts double, node string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    by = lambda r: sorted(map(tuple, graph.correlate(rows, 300.0, edges, r).collect()))
    assert by(0) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert by(1) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_hub_in_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_PART", 4)
    touched, edges = made(7, span=60_000)
    rows = spark.createDataFrame(touched, "event_id long, ts double, node string")
    out = graph.correlate(rows, 300.0, spark.createDataFrame(edges, "src string, dst string"), 2).collect()
    assert {r["event_id"]: r["group_id"] for r in out} == pairs(touched, edges, 300.0, 2)


def test_hot_node_is_a_cell_a_slice(spark):
    """A node that every event touches: a label for each slice, and one group where no gap is longer than the window."""
    touched = [(i, i * 1.0 + (10_000 if i >= 20_000 else 0), "host:hot") for i in range(40_000)]
    rows = spark.createDataFrame(touched, "event_id long, ts double, node string")
    out = graph.correlate(rows, 300.0).groupBy("group_id").count().collect()
    assert sorted(map(tuple, out)) == [(0, 20_000), (20_000, 20_000)]


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_leaves_and_lone_pairs(spark, radius):
    """Stars with a leaf or many, chains of two and three nodes, and a leaf that is touched alone."""
    draw = random.Random(radius)
    edges = [(f"hub{h}", f"leaf{h}.{i}") for h in range(4) for i in range(6)] + [("hub0", "hub1"), ("hub1", "mid"), ("mid", "hub2")]
    edges += [("x", "y"), ("q", "p"), ("c1", "c2"), ("c2", "c3"), ("c3", "c4")]
    nodes = sorted({n for e in edges for n in e})
    touched = [(e, float(draw.randrange(0, 30_000, 50)), draw.choice(nodes)) for e in range(250)]
    rows = spark.createDataFrame(touched, "event_id long, ts double, node string")
    out = graph.correlate(rows, 300.0, spark.createDataFrame(edges, "src string, dst string"), radius).collect()
    assert {r["event_id"]: r["group_id"] for r in out} == pairs(touched, edges, 300.0, radius)


def test_cells_of_a_hub_are_not_spread_to_its_leaves(spark, monkeypatch):
    sent, spread = [], graph._spread
    monkeypatch.setattr(graph, "_spread", lambda *a: sent.append(spread(*a)) or sent[-1])
    edges = spark.range(300).selectExpr("'hub' AS src", "concat('leaf', id) AS dst")
    touched = spark.range(600).selectExpr("id AS event_id", "id * 1000.0D AS ts", "explode(array('hub', concat('leaf', id % 300))) AS node")
    assert graph.correlate(touched, 300.0, edges, 2).select("group_id").distinct().count() == 600
    # the hub has a cell for each event, and each leaf's cells go to it alone
    assert sent[0].count() == 600


def test_empty_and_missing_edges(spark):
    rows = spark.createDataFrame([], "event_id long, ts double, node string")
    assert graph.correlate(rows).collect() == []
    with pytest.raises(ValueError):
        graph.correlate(rows, radius=2)

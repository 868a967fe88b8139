"""Suspicious paths by bounds against all simple paths, and a hub that leads nowhere."""

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import graph

NODE, EDGE = "node string, detection_score double", "src string, dst string, type string"


def plain(nodes, edges, seeds, depth, min_score):
    hot, gain, out = dict(nodes), {}, {}
    for s, d, t in edges:
        if d in hot:
            gain[s, d] = gain.get((s, d), 0.0) + {"connected": 0.15, "wrote": 0.05}.get(t, 0.0)

    def go(path, top, bonus):
        if len(path) > 1:
            score = min(1.0, top + (bonus if len(path) > 2 else 0.0))
            if score >= min_score:
                out[tuple(path)] = round(score, 9)
        if len(path) < depth:
            for (s, d), g in gain.items():
                if s == path[-1] and d not in path:
                    go([*path, d], max(top, hot[d] or 0.0), bonus + g)

    for s in seeds:
        if s in hot:
            go([s], 0.0, 0.0)
    return out


@pytest.mark.parametrize("seed, depth, min_score", [(1, 4, 0.3), (2, 4, 0.6), (3, 5, 0.45), (4, 2, 0.3), (5, 4, 1.5)])
def test_as_all_paths(spark, seed, depth, min_score):
    draw = random.Random(seed)
    nodes = [(f"n{i}", draw.choice([None, 0.0, 0.1, 0.25, 0.5, 0.9])) for i in range(25)]
    edges = [(f"n{draw.randrange(26)}", f"n{draw.randrange(26)}", draw.choice(["connected", "wrote", "read", "spawned"])) for _ in range(70)]
    seeds = ["n1", "n2", "n3", "missing"]
    frames = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in seeds + ["n1"]], "node string")
    got = graph.suspicious_paths(*frames, depth, min_score).collect()
    want = plain(nodes, edges, seeds, depth, min_score)
    assert {tuple(r["path"]): round(r["score"], 9) for r in got} == want and len(got) == len(want)


def test_a_hub_below_the_score_makes_no_rows(spark, monkeypatch):
    """10^5 neighbours that lead nowhere: no layer holds a path through them."""
    hub = spark.range(100_000).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), "id").alias("dst"), F.lit("read").alias("type"))
    edges = hub.unionByName(spark.createDataFrame([("seed", "hub", "wrote"), ("seed", "a", "read"), ("a", "b", "connected")], EDGE))
    nodes = hub.select(F.col("dst").alias("node"), F.lit(0.1).alias("detection_score")).unionByName(spark.createDataFrame([("seed", 0.0), ("hub", 0.0), ("a", 0.0), ("b", 0.5)], NODE))
    kept = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, real=graph.checkpointed: kept.append(out := real(df)) or out)
    out = graph.suspicious_paths(nodes, edges, spark.createDataFrame([("seed",)], "node string"))
    assert [tuple(r["path"]) for r in out.collect()] == [("seed", "a", "b")]
    assert sum(df.count() for df in kept if "path" in df.columns) == 2

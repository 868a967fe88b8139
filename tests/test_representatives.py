"""Representative instances against a plain k-means with the same first centres."""

import random

import numpy as np
from pyspark.sql import functions as F

from sentrylake.operators import representatives as rep

SCHEMA = "program string, instance long, action string"


def plain_kmeans(points, k, rounds, drawn):
    """points: {instance: x}; drawn: instances by seeded hash.  (cluster of each, centres)."""
    x = np.stack([points[i] for i in drawn[: k * rep.SEED_POINTS]])
    centres = x[rep.first_centres(x, k)].copy()
    ids = sorted(points)
    p = np.stack([points[i] for i in ids])
    for _ in range(rounds):
        at = ((p[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        following = np.stack([p[at == c].mean(axis=0).round(9) if (at == c).any() else centres[c] for c in range(len(centres))])
        done = np.allclose(following, centres, atol=1e-12)
        centres = following
        if done:
            break
    d = ((p[:, None] - centres[None]) ** 2).sum(axis=2)
    return dict(zip(ids, d.argmin(axis=1))), dict(zip(ids, np.sqrt(d.min(axis=1))))


def edges_of(spark):
    draw, rows = random.Random(1), []
    # one program with 40 instances of four kinds, one with one, one with exactly k, and a hot one
    for i in range(40):
        kind = i % 4
        rows += [("forty", i, f"kind {kind} action {draw.randrange(3)}") for _ in range(12)]
    rows += [("single", 900, "start")] * 3
    rows += [("exact", 1_000 + i, f"a{i}") for i in range(4)]
    rows += [("hot", 10_000 + i, f"h{(i % 5) * 10 + draw.randrange(2)}") for i in range(3_000) for _ in range(2)]
    return spark.createDataFrame(rows + [(None, 1, "x"), ("forty", None, "x")], SCHEMA)


def test_as_a_plain_kmeans(spark):
    edges = edges_of(spark)
    points = rep.instance_vectors(edges, "program", "instance", F.col("action"))
    assert points.count() == 40 + 1 + 4 + 3_000
    rows = points.where("program = 'forty'").select("instance", "x", F.xxhash64("instance", F.lit(42)).alias("h")).collect()
    known = {r["instance"]: np.array(r["x"]) for r in rows}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in known.values())
    drawn = [r["instance"] for r in sorted(rows, key=lambda r: (r["h"], r["instance"]))]
    cluster, distance = plain_kmeans(known, 6, 10, drawn)
    got = rep.cluster_programs(points.where("program = 'forty'"), 6).collect()
    assert {r["instance"]: r["cluster"] for r in got} == cluster
    assert all(abs(r["distance"] - distance[r["instance"]]) < 1e-9 for r in got)


def test_representatives(spark):
    rows = rep.representative_actors(edges_of(spark), "program", "instance", F.col("action"), k=4).collect()
    of = {p: [r for r in rows if r["program"] == p] for p in ("forty", "single", "exact", "hot")}
    assert len(rows) == sum(map(len, of.values()))
    # one of each kind, which are far apart
    assert sorted(r["instance"] % 4 for r in of["forty"]) == [0, 1, 2, 3] and {r["members"] for r in of["forty"]} == {10}
    assert [r["instance"] for r in of["single"]] == [900]
    assert sorted(r["instance"] for r in of["exact"]) == [1_000, 1_001, 1_002, 1_003]
    assert 1 < len(of["hot"]) <= 4 and sum(r["members"] for r in of["hot"]) == 3_000


def test_hot_program_in_parts(spark):
    points = rep.instance_vectors(edges_of(spark), "program", "instance", F.col("action")).where("program = 'hot'")
    whole, parts = ({(r["instance"], r["cluster"]) for r in rep.cluster_programs(points, 4, part_rows=n).collect()} for n in (50_000, 100))
    assert whole == parts and len(whole) == 3_000


def test_empty(spark):
    assert rep.representative_actors(spark.createDataFrame([], SCHEMA), "program", "instance", F.col("action")).collect() == []

"""Classifier, staged refinement and leave-one-out against plain versions on fifty nodes."""

import math

import numpy as np
import pytest

from sentrylake.operators import attribution


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    train = [(f"p{i % 5}", int(i % 3), (rng.normal(size=2) + 3 * (i % 3)).tolist()) for i in range(50)]
    test = [(i, f"e{i}" if i < 4 else None, (rng.normal(size=2) + i % 7).tolist()) for i in range(20)]
    return train, test


def plain_scores(train, test, omitted):
    """Confidences of the asked nodes by a model trained on the rows without the omitted entity, row by row."""
    own = [r for r in train if r[0] != omitted]
    classes = {}
    for label in sorted({r[1] for r in train}):
        xs = [r[2] for r in own if r[1] == label]
        mean = [sum(x[d] for x in xs) / len(xs) for d in (0, 1)]
        classes[label] = len(xs) / len(own), mean, [sum(x[d] ** 2 for x in xs) / len(xs) - mean[d] ** 2 for d in (0, 1)]
    most = max(max(v) for _, _, v in classes.values())
    c = []
    for _, _, x in test:
        p = sorted((prior * math.prod(math.exp(-((x[d] - m[d]) ** 2) / 2 / (v[d] + 1e-6 * most)) / math.sqrt(2 * math.pi * (v[d] + 1e-6 * most)) for d in (0, 1)) for prior, m, v in classes.values()), reverse=True)
        c.append((p[0] - p[1]) / p[0])
    return {e: (c[i] - min(c)) / max(c) for i, (_, e, _) in enumerate(test) if e}


def frames(spark, rows):
    return spark.createDataFrame(rows[0], "entity string, label int, x array<double>"), spark.createDataFrame(rows[1], "node long, entity string, x array<double>")


@pytest.mark.parametrize("block", [256, 2])
def test_leave_one_out(spark, rows, block):
    got = {}
    for r in attribution.leave_one_out_scores(*frames(spark, rows), block=block).collect():
        got.setdefault(r["omitted"], {})[r["entity"]] = r["score"]
    assert set(got) == {"zeroth", "p0", "p1", "p2", "p3", "p4"}
    for omitted, scores in got.items():
        assert scores == pytest.approx(plain_scores(*rows, omitted), abs=1e-6)


def test_sharded_leave_one_out(spark, rows):
    train, test = frames(spark, rows)
    got = attribution.sharded_leave_one_out(train, test, 3).collect()
    members = {}
    for r in got:
        members.setdefault(r["shard"], set()).add(r["omitted"])
    assert all("zeroth" in m and len(m) >= 3 for m in members.values()) and len(members) == 2
    shard, own = next(iter(members.items()))
    want = plain_scores([r for r in rows[0] if r[0] in own], rows[1], "zeroth")
    assert {r["entity"]: r["score"] for r in got if (r["shard"], r["omitted"]) == (shard, "zeroth")} == pytest.approx(want, abs=1e-6)
    assert attribution.sharded_leave_one_out(train, test, 3, min_entities=9).collect() == []


def test_anomalies_and_stages(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=2) * 0.3 + 4 * (i % 3)).tolist(), i % 3) for i in range(60)] + [(100, [0.0, 0.0], 2), (101, [8.0, 8.0], 0)]
    nodes = spark.createDataFrame(rows, "node long, x array<double>, label int")
    found = attribution.predict_node_types(attribution.fit_node_types(nodes), nodes)
    assert {r["node"] for r in attribution.node_anomalies(found).collect()} == {100, 101}
    assert {r["node"] for r in attribution.node_anomalies(found, only=0).collect()} == {101}
    assert not attribution.node_anomalies(found, gate=1.0).collect()
    assert {r["node"] for r in attribution.staged_refinement(nodes, stages=1).collect()} == {100, 101}
    assert {r["node"] for r in attribution.staged_refinement(nodes, stages=3).collect()} <= {100, 101}


def test_batch_embed_pools_by_kind(spark):
    def encoder(texts):
        size = max(1, max(len(t.split()) for t in texts))
        vectors, mask = np.zeros((len(texts), size, 2)), np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for j, w in enumerate(t.split()):
                vectors[i, j], mask[i, j] = (len(w), j), 1
        return vectors, mask

    df = spark.createDataFrame([(1, "a bbb"), (2, ""), (3, None), (4, "cc")], "id long, text string")
    get = lambda kind: {r["id"]: r["x"] for r in attribution.batch_embed(df, encoder, kind, batch=2).collect()}
    assert get("log") == {1: [2.0, 0.5], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [2.0, 0.0]}
    assert get("command")[1] == [1.0, 0.0]

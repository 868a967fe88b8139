"""Models without an entity by one step against models that are fitted again without it."""

import numpy as np
from pyspark.sql import functions as F

from sentrylake.operators import influence

REG = 1e-2


def refit(x, label, classes, steps=60):
    """Newton's method to the end."""
    theta = np.zeros((classes, x.shape[1] + 1))
    ridge = np.diag(np.hstack([np.ones((classes, x.shape[1])), np.zeros((classes, 1))]).ravel()) * REG
    for _ in range(steps):
        g, h = influence.row_sums(x, label, theta)
        weights = np.hstack([theta[:, :-1], np.zeros((classes, 1))]).ravel()
        theta = theta - np.linalg.lstsq(h / len(x) + ridge, g / len(x) + REG * weights, rcond=1e-12)[0].reshape(theta.shape)
    return theta


def data(n=300, entities=12, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 2)) + np.array([[0, 0], [1.5, 0], [0, 1.5]])[label]
    # one entity has a third of the rows
    entity = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, entities, n))
    return x, label, entity


def frames(spark):
    x, label, entity = data()
    nodes, _, _ = data(50, seed=2)
    train = spark.createDataFrame([(f"e{e}", int(c), v.tolist()) for v, c, e in zip(x, label, entity)], "entity string, label int, x array<double>").repartition(5)
    test = spark.createDataFrame([(i, f"t{i}" if i % 5 == 0 else None, v.tolist()) for i, v in enumerate(nodes)], "node long, entity string, x array<double>")
    return (x, label, entity), nodes, train, test


def margins(nodes, theta):
    top = np.sort(influence._probabilities(influence._with_one(nodes), theta), axis=1)[:, -2:]
    return (top[:, 1] - top[:, 0]) / top[:, 1]


def test_models_as_fitted_again(spark):
    (x, label, entity), nodes, train, _ = frames(spark)
    got = {r["omitted"]: np.array(r["theta"]).reshape(3, -1) for r in influence.leave_one_out_models(train, REG).collect()}
    assert set(got) == {"zeroth", *(f"e{e}" for e in set(entity.tolist()))}
    assert np.abs(margins(nodes, got["zeroth"]) - margins(nodes, refit(x, label, 3))).max() < 1e-4
    for e in set(entity.tolist()):
        keep = entity != e
        full = margins(nodes, refit(x[keep], label[keep], 3))
        # within 0.01 for an entity of a few rows, 0.05 for one of a third
        assert np.abs(margins(nodes, got[f"e{e}"]) - full).max() < (0.05 if e == 0 else 0.01), e


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(influence, "BLOCK", 4)
    monkeypatch.setattr(influence, "CHUNK", 16)
    monkeypatch.setattr(influence, "HELD", 3)
    _, nodes, train, test = frames(spark)
    thetas = {r["omitted"]: np.array(r["theta"]).reshape(3, -1) for r in influence.leave_one_out_models(train, REG).collect()}
    want = {}
    for name, theta in thetas.items():
        c = margins(nodes, theta)
        for i in range(0, 50, 5):
            want[name, f"t{i}"] = (c[i] - c.min()) / c.max()
    out = influence.influence_scores(train, test, REG).collect()
    assert len(out) == len(want) and all(abs(want[r["omitted"], r["entity"]] - r["score"]) < 1e-5 for r in out)


def test_many_entities(spark):
    """Entities go through tasks: 3,000 of them, and no list of them on the driver."""
    train = spark.range(6_000).select(F.concat(F.lit("e"), F.floor(F.col("id") / 2)).alias("entity"), (F.col("id") % 2).cast("int").alias("label"), F.array((F.col("id") % 2) + F.rand(1), F.rand(2)).alias("x"))
    assert influence.leave_one_out_models(train).count() == 3_001

"""Leave-one-out of the node classifier by one Newton step for each entity.

The classifier is the multinomial regression of ``fit_node_types`` on plain
features.  At its optimum the model without an entity is one step away: the
entity's gradients, solved by the Hessian of the other rows.  Gradients and
Hessians are sums over rows, so one pass makes those of all entities; they are
summed in each task, then in parts, then by entity, so no entity's rows meet
anywhere.  Models are made and nodes are scored in tasks, blocks of models
against chunks of nodes; the driver sees one model and one Hessian, whose size is
that of the classifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.checkpoints import checkpointed

#: Parts in which an entity's sums of tasks are summed first; models in a block; nodes in a chunk; entities that a task sums at a time.
PARTS, BLOCK, CHUNK, HELD = 64, 64, 1_024, 256


def fit_plain(train: DataFrame, reg: float = 1e-2, max_iter: int = 300) -> np.ndarray:
    """Weights and intercepts, a row for each class 0, 1, ..: the minimum of the mean loss plus reg / 2 times the squared weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial", standardization=False, tol=1e-10).fit(rows)
    return np.hstack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]])


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _probabilities(x1: np.ndarray, theta: np.ndarray) -> np.ndarray:
    z = x1 @ theta.T
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def row_sums(x: np.ndarray, label: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of the loss's gradient and Hessian, flat by class and feature."""
    x1 = _with_one(x)
    p = _probabilities(x1, theta)
    gradient = ((p - np.eye(len(theta))[label]).T @ x1).ravel()
    spread = p[:, :, None] * (np.eye(len(theta)) - p[:, None, :])
    return gradient, np.einsum("nab,ni,nj->aibj", spread, x1, x1).reshape(theta.size, theta.size)


def without(theta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, whole: np.ndarray, n: int, n_all: int, reg: float) -> np.ndarray:
    """The classifier without n rows of n_all: one Newton step from theta, their gradient and Hessian and that of all rows given."""
    left = n_all - n
    if left <= 0:
        return theta
    weights = np.hstack([theta[:, :-1], np.zeros((len(theta), 1))]).ravel()
    ridge = np.diag(np.hstack([np.ones((len(theta), theta.shape[1] - 1)), np.zeros((len(theta), 1))]).ravel()) * reg
    step = np.linalg.lstsq((whole - hessian) / left + ridge, -(gradient + n * reg * weights) / left, rcond=1e-12)[0]
    return theta - step.reshape(theta.shape)


def entity_sums(train: DataFrame, theta: np.ndarray) -> DataFrame:
    """(entity, n, g, h): rows, gradient and Hessian of each entity."""
    schema = f"entity {train.schema['entity'].dataType.simpleString()}, n long, g array<double>, h array<double>"

    def by_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"entity": list(held), "n": [v[0] for v in held.values()], "g": [v[1] for v in held.values()], "h": [v[2].ravel() for v in held.values()]})

        for batch in batches:
            for entity, rows in batch.groupby("entity", sort=False):
                g, h = row_sums(np.stack(rows["x"].to_numpy()).astype(float), rows["label"].to_numpy().astype(int), theta)
                n0, g0, h0 = held.get(entity, (0, 0.0, 0.0))
                held[entity] = (n0 + len(rows), g0 + g, h0 + h)
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"entity": rows["entity"].iloc[:1], "n": [int(rows["n"].sum())], "g": [np.sum(np.stack(rows["g"].to_numpy()), axis=0)], "h": [np.sum(np.stack(rows["h"].to_numpy()), axis=0)]})

    partial = train.where(F.col("entity").isNotNull()).select("entity", "label", "x").mapInPandas(by_task, schema).withColumn("part", F.spark_partition_id() % PARTS)
    return partial.groupBy("entity", "part").applyInPandas(added, schema).groupBy("entity").applyInPandas(added, schema)


def leave_one_out_models(train: DataFrame, reg: float = 1e-2) -> DataFrame:
    """(omitted, theta): the classifier of all rows (``zeroth``) and that without each entity, flat."""
    theta = fit_plain(train, reg)
    sums = checkpointed(entity_sums(train, theta))
    size = theta.size

    def all_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, h = 0, np.zeros(size * size)
        for batch in batches:
            n += int(batch["n"].sum())
            h += np.sum(np.stack(batch["h"].to_numpy()), axis=0) if len(batch) else 0.0
        yield pd.DataFrame({"n": [n], "h": [h]})

    # a Hessian a task, then one
    totals = sums.select("n", "h").mapInPandas(all_of, "n long, h array<double>").coalesce(1).mapInPandas(all_of, "n long, h array<double>").first()
    n_all, whole = totals["n"], np.array(totals["h"]).reshape(size, size)

    def models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [without(theta, np.asarray(g), np.asarray(h).reshape(size, size), whole, int(n), n_all, reg).ravel() for n, g, h in zip(batch["n"], batch["g"], batch["h"])]
            yield pd.DataFrame({"omitted": batch["entity"], "theta": made})

    zeroth = train.sparkSession.createDataFrame([("zeroth", theta.ravel().tolist())], "omitted string, theta array<double>")
    return zeroth.unionByName(sums.withColumn("entity", F.col("entity").cast("string")).mapInPandas(models, "omitted string, theta array<double>"))


def influence_scores(train: DataFrame, test: DataFrame, reg: float = 1e-2) -> DataFrame:
    """(omitted, entity, score) as ``leave_one_out_scores`` gives them, for the classifier of M08.

    train: (entity, label, x), labels 0, 1, ..; test: (node, entity, x) with the
    entity null for nodes that are not asked about.  A node's confidence is
    (p1 - p2) / p1, less the least of all nodes, over the greatest; of an
    entity's nodes the last counts.  Every node is scored by every model, as the
    least and the greatest are those of all nodes; a task does a block of models
    against a chunk of nodes.
    """
    models = checkpointed(leave_one_out_models(train, reg))
    n_models, n_nodes = models.count(), test.count()
    blocks, chunks = -(-n_models // BLOCK), max(1, -(-n_nodes // CHUNK))
    classes = train.agg(F.max("label")).first()[0] + 1
    dealt = models.withColumn("block", F.pmod(F.xxhash64("omitted"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list("omitted").alias("names"), F.flatten(F.collect_list("theta")).alias("thetas"))
    # numbers of all nodes in one flat array; names of those only that are asked about
    own = F.when(F.col("entity").isNotNull(), F.struct("node", F.col("entity").cast("string").alias("entity"), "x"))
    nodes = test.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int")).groupBy("chunk").agg(F.flatten(F.collect_list("x")).alias("xs"), F.collect_list(own).alias("own"))
    nodes = nodes.select("xs", F.transform("own", lambda r: r["node"]).alias("nodes"), F.transform("own", lambda r: r["entity"]).alias("entities"), F.flatten(F.transform("own", lambda r: r["x"])).alias("own_xs"))
    pairs = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "block")
    node = test.schema["node"].dataType.simpleString()

    def confidence(x: np.ndarray, thetas: np.ndarray) -> np.ndarray:
        top = np.sort(_probabilities(_with_one(x), thetas), axis=1)[:, -2:]
        return (top[:, 1] - top[:, 0]) / top[:, 1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a chunk at a time: what a task holds does not grow with the rows of a batch
            for at in range(batch.num_rows):
                names, thetas, xs, ids, entities, own_xs = (batch.column(c)[at].values for c in ("names", "thetas", "xs", "nodes", "entities", "own_xs"))
                thetas = np.asarray(thetas).reshape(len(names), classes, -1)
                size = thetas.shape[2] - 1
                x, own_x = np.asarray(xs).reshape(-1, size), np.asarray(own_xs).reshape(-1, size)
                last = pd.DataFrame({"node": ids.to_pylist(), "entity": entities.to_pylist()}).sort_values("node", kind="stable").drop_duplicates("entity", keep="last")
                # of an entity's nodes in a chunk the last can count
                kept = last.index.to_numpy()
                out = {c: [] for c in ("omitted", "node", "entity", "lo", "hi")}
                for name, theta in zip(names.to_pylist(), thetas):
                    c = confidence(x, theta)
                    mine = confidence(own_x[kept], theta).tolist()
                    for k, v in zip(out, ([name] * (1 + len(mine)), [None, *last["node"]], [None, *last["entity"]], [float(c.min()), *mine], [float(c.max()), *mine])):
                        out[k] += v
                yield pa.RecordBatch.from_pydict(out, schema=made)

    schema = f"omitted string, node {node}, entity string, lo double, hi double"
    made = to_arrow_schema(test.sparkSession.createDataFrame([], schema).schema)
    raw = checkpointed(pairs.select("names", "thetas", "xs", "nodes", "entities", "own_xs").mapInArrow(score, schema))
    span = raw.where("entity is null").groupBy("omitted").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    last = raw.where("entity is not null").groupBy("omitted", "entity").agg(F.max_by("lo", "node").alias("c"))
    return last.join(span, "omitted").select("omitted", "entity", ((F.col("c") - F.col("least")) / F.col("most")).alias("score"))

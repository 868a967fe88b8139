"""Node classifiers on features, what they find odd, and how much each training entity bears on a score."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import checkpointed
from .traces import balanced_shards

#: Candidates whose models are made at once; with the classes and features this bounds what a task is sent.
BLOCK = 256


def fit_node_types(nodes: DataFrame, max_iter: int = 100, reg: float = 1e-3):
    """A multinomial regression by Spark ML from x to label (0, 1, ..); nodes: (node, x, label)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = nodes.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial").fit(rows)


def predict_node_types(model, nodes: DataFrame) -> DataFrame:
    """(node, label, predicted, confidence); the confidence is W22's over all of ``nodes``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = model.transform(nodes.select("node", "label", array_to_vector("x").alias("features")))
    best = F.sort_array(vector_to_array("probability"), asc=False)
    c = (F.get(best, F.lit(0)) - F.get(best, F.lit(1))) / F.get(best, F.lit(0))
    rows = checkpointed(rows.select("node", "label", F.col("prediction").cast("int").alias("predicted"), c.alias("c")))
    # W22 beside the rows, so that no node is joined to itself
    span = rows.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return rows.join(F.broadcast(span)).select("node", "label", "predicted", ((F.col("c") - F.col("lo")) / F.col("hi")).alias("confidence"))


def node_anomalies(predictions: DataFrame, gate: float | None = None, only: int | None = None) -> DataFrame:
    """Nodes whose predicted type is not their own, of a confidence above the gate, and of one type if that is asked for."""
    odd = predictions.where("predicted <> label")
    if gate is not None:
        odd = odd.where(F.col("confidence") > gate)
    return odd if only is None else odd.where(F.col("label") == only)


def staged_refinement(nodes: DataFrame, stages: int = 3, gate: float = 0.9) -> DataFrame:
    """(node, label): nodes that every one of up to ``stages`` models takes for another type.

    Each model is fitted on what the one before got wrong without being sure
    (a confidence below the gate); the last ones are left out when nothing or one
    type only remains.
    """
    nodes = checkpointed(nodes)
    left, flagged = nodes, nodes.select("node", "label")
    for _ in range(stages):
        if left.select("label").distinct().limit(2).count() < 2:
            break
        model = fit_node_types(left)
        wrong = predict_node_types(model, nodes).where("predicted <> label").select("node")
        flagged = checkpointed(flagged.join(wrong, "node", "left_semi"))
        unsure = predict_node_types(model, left).where((F.col("predicted") != F.col("label")) & (F.col("confidence") < gate)).select("node")
        left = checkpointed(left.join(unsure, "node", "left_semi"))
    return flagged


def _statistics(train: DataFrame) -> DataFrame:
    """(entity, label, i, n, s, q): rows, sums and sums of squares of each feature; summed in each task first."""
    rows = train.select("entity", "label", F.posexplode("x").alias("i", "v"))
    return rows.groupBy("entity", "label", "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def _models(n: np.ndarray, s: np.ndarray, q: np.ndarray, smoothing: float):
    """(log priors, means, variances) of Gaussian classes from counts and sums, of any number of models at once."""
    total = np.maximum(n, 1e-12)
    mean = s / total[..., None]
    var = np.maximum(q / total[..., None] - mean**2, 0.0)
    var = var + smoothing * np.maximum(var.max(axis=(-1, -2), keepdims=True), 1e-9)
    with np.errstate(divide="ignore"):
        prior = np.log(n / n.sum(axis=-1, keepdims=True))
    return prior, mean, var


def margins(x: np.ndarray, prior: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(p1 - p2) / p1 of the two likeliest classes, rows by models."""
    out = np.empty((len(x), len(prior)))
    for m in range(len(prior)):
        log = prior[m] - 0.5 * (np.log(2 * np.pi * var[m]).sum(axis=-1) + ((x[:, None, :] - mean[m]) ** 2 / var[m]).sum(axis=-1))
        top = np.sort(log, axis=1)[:, -2:]
        out[:, m] = 1 - np.exp(top[:, 0] - top[:, 1])
    return out


def leave_one_out_scores(train: DataFrame, test: DataFrame, candidates: Sequence[str] | None = None, block: int = BLOCK, smoothing: float = 1e-6) -> DataFrame:
    """(omitted, entity, score): each test entity's confidence by a model without each training entity, and without none (``zeroth``).

    train: (entity, label, x), test: (node, entity, x) with the entity null for
    nodes that are not asked about.  The classes are Gaussian, so a model is sums
    over rows and the model without an entity is those sums less the entity's:
    one pass over the training rows trains all of them.  A pass over the test nodes
    scores ``block`` models; only these models, and no rows, go through the driver.
    A node's confidence is (p1 - p2) / p1, less the least of all nodes, over the
    greatest; of an entity's nodes the last counts.
    """
    stats = checkpointed(_statistics(train).withColumn("shard", F.lit(0)))
    return _left_out(stats, test, candidates, block, smoothing).select("omitted", "entity", "score")


def _left_out(stats: DataFrame, test: DataFrame, candidates: Sequence[str] | None, block: int, smoothing: float) -> DataFrame:
    """(shard, omitted, entity, score): the models of all shards, ``block`` of them in one pass over the test nodes."""
    sums = stats.groupBy("shard", "label", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    labels, size = sorted({r["label"] for r in sums}), 1 + max((r["i"] for r in sums), default=-1)
    place, shards = {label: k for k, label in enumerate(labels)}, sorted({r["shard"] for r in sums})

    def arrays(rows, shape):
        n, s, q = np.zeros(shape[:-1]), np.zeros(shape), np.zeros(shape)
        for at, r in rows:
            n[at], s[(*at, r["i"])], q[(*at, r["i"])] = r["n"], r["s"], r["q"]
        return n, s, q

    of = {shard: k for k, shard in enumerate(shards)}
    whole = arrays((((of[r["shard"]], place[r["label"]]), r) for r in sums), (len(shards), len(labels), size))
    if candidates is None:
        names = [(r["shard"], r["entity"]) for r in stats.select("shard", "entity").distinct().orderBy("shard", "entity").collect()]
    else:
        names = [(shard, name) for shard in shards for name in candidates]
    found = None
    base = [(shard, "zeroth") for shard in shards]
    blocks = [base + names[:block], *(names[i : i + block] for i in range(block, len(names), block))]
    for wanted in blocks:
        at = {name: k for k, name in enumerate(wanted)}
        own = stats.where(F.col("entity").isin(sorted({name for _, name in wanted if name is not None}))).collect()
        gone = arrays((((at[r["shard"], r["entity"]], place[r["label"]]), r) for r in own if r["entity"] != "zeroth" and (r["shard"], r["entity"]) in at), (len(wanted), len(labels), size))
        mine = [of[shard] for shard, _ in wanted]
        part = _scored(test, wanted, _models(*(w[mine] - g for w, g in zip(whole, gone)), smoothing))
        found = part if found is None else found.unionByName(part)
    return found


def _scored(test: DataFrame, names: list[tuple[int, str]], models) -> DataFrame:
    shared = test.sparkSession.sparkContext.broadcast((names, models))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, models = shared.value
        shards, omitted = [n[0] for n in names], [n[1] for n in names]
        for batch in batches:
            if not len(batch):
                continue
            c = margins(np.stack(batch["x"].to_numpy()).astype(np.float64), *models)
            # of an entity's nodes in a batch the last can count
            last = batch[["node", "entity"]].reset_index(drop=True).dropna(subset="entity").sort_values("node", kind="stable").drop_duplicates("entity", keep="last")
            own_c = c[last.index.to_numpy()].ravel()
            ends = pd.DataFrame({"shard": shards, "omitted": omitted, "node": None, "entity": None, "lo": c.min(axis=0), "hi": c.max(axis=0)})
            own = pd.DataFrame({"shard": np.tile(shards, len(last)), "omitted": omitted * len(last), "node": np.repeat(last["node"].to_numpy(), len(names)), "entity": np.repeat(last["entity"].to_numpy(), len(names)), "lo": own_c, "hi": own_c})
            yield pd.concat([ends, own]) if len(own) else ends

    node = test.schema["node"].dataType.simpleString()
    raw = checkpointed(test.mapInPandas(score, f"shard int, omitted string, node {node}, entity string, lo double, hi double"))
    span = raw.where("entity is null").groupBy("shard", "omitted").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    last = raw.where("entity is not null").groupBy("shard", "omitted", "entity").agg(F.max_by("lo", "node").alias("c"))
    return last.join(F.broadcast(span), ["shard", "omitted"]).select("shard", "omitted", "entity", ((F.col("c") - F.col("least")) / F.col("most")).alias("score"))


def sharded_leave_one_out(train: DataFrame, test: DataFrame, shards: int, min_entities: int = 2, block: int = BLOCK) -> DataFrame:
    """(shard, omitted, entity, score): M11 inside each of ``shards`` parts of the entities, even by rows; parts of fewer entities are left out.

    The sums of an entity are made once and the test nodes read once for all parts.
    """
    dealt = balanced_shards(train, "entity", shards)
    enough = dealt.groupBy("shard").agg(F.count("*").alias("entities")).where(F.col("entities") >= min_entities).select("shard")
    dealt = checkpointed(dealt.join(F.broadcast(enough), "shard").select(F.col("value").alias("entity"), "shard"))
    if dealt.isEmpty():
        return test.sparkSession.createDataFrame([], "shard int, omitted string, entity string, score double")
    return _left_out(checkpointed(_statistics(train).join(dealt, "entity")), test, None, block, 1e-6)


def batch_embed(texts: DataFrame, encoder: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: str, id_col: str = "id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """(id, x) by a user's encoder, which gives token vectors (texts, tokens, size) and a mask for a batch of texts.

    Commands take the first token's vector, logs and system events the mean of
    the masked ones; a text without a token gets zeros.  Null texts count as empty.
    """
    first = kind == "command"

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                vectors, mask = encoder(part["text"].fillna("").tolist())
                mean = (vectors * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "x": list((vectors[:, 0] if first else mean).astype(np.float64))})

    kind_of_id = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(embed, f"id {kind_of_id}, x array<double>")

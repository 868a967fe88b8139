"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Fitting reads a bounded sample of labelled documents, ``max_labelled`` at most.
Spark counts in how many documents of either class each hashed n-gram occurs;
the log-count ratio of a bucket is ``log((p + a) / |p|) - log((n + a) / |n|)``
with Laplace's ``a`` and the 1-norms of both count vectors.  A logistic
regression on presence times ratio is then fitted by Spark ML.  Scoring is one pass
without a shuffle.

``min_z`` (0: all): buckets whose rates in the two classes differ by less than so
many standard errors are no features; a million buckets of rare n-grams fit the
noise of a few thousand labels.  There is no cap on their number.

An n-gram is of code points of the lower-cased text, white space collapsed, with
a space at either end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

ORDERS = (4, 5, 6)
BITS = 20
BLOCK = 4_096
MAX_LABELLED = 20_000
#: Standard errors by which a feature's rates in the classes differ at least.
MIN_Z = 5.0
#: Code points of text that are hashed at once.
SLICE_CHARS = 1 << 19
_BASE, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    """weights: of each bucket, 0 for those left out; 4 MB at 20 bits."""

    weights: np.ndarray = field(repr=False)
    intercept: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS


def _normal(text: str) -> str:
    return " " + " ".join(text.lower().split()) + " "


def _hits(texts: list[str], orders: tuple[int, ...], bits: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each different n-gram bucket of each document, if wanted (None: all), ascending."""
    starts = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    shift, found = np.uint32(32 - bits), []
    h = data
    for n in range(2, max(orders) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * _BASE + data[n - 1 :]
        if n in orders:
            bucket = ((h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * _MIX) >> shift
            at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + n <= starts[doc + 1]
            found.append(doc[inside].astype(np.int64) << bits | bucket[at[inside]])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > SLICE_CHARS:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """(label, text) of at most ``max_labelled`` labelled documents, those whose id hashes lowest.

    The chosen ids take 20 bytes each, so their broadcast is bounded by the parameter.
    """
    chosen = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    # a few even partitions: what they count is summed once for each
    return texts.join(F.broadcast(chosen), "_id").select("label", "text").repartition(16)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "toxic",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
    orders: tuple[int, ...] = ORDERS,
    bits: int = BITS,
    min_z: float = MIN_Z,
    laplace: float = 1.0,
    reg: float = 1e-4,
) -> Model:
    """A model of ``label_col`` (1 or 0) learned from the labelled documents.

    Nothing but the texts and that column is used.  With no labelled row, or
    with one class only, the model is the constant rate of label 1 (0.5 over
    no rows).  Null labels are left out, null texts count as empty, an id that
    is labelled twice counts with its larger label.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, id_col, label_col, text_col, max_labelled).persist()
    size, blocks = 1 << bits, (1 << bits) // BLOCK

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, size), np.int32)
        for batch in batches:
            label = batch["label"].to_numpy()
            texts = [_normal(t) for t in batch["text"]]
            for begin, part in _slices(texts):
                doc, bucket = _hits(part, orders, bits, None)
                one = label[begin + doc] == 1
                counts[1] += np.bincount(bucket[one], minlength=size).astype(np.int32)
                counts[0] += np.bincount(bucket[~one], minlength=size).astype(np.int32)
        yield pd.DataFrame({"block": range(blocks), **{f"c{i}": [counts[i, b * BLOCK : (b + 1) * BLOCK].tobytes() for b in range(blocks)] for i in (0, 1)}})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {f"c{i}": [np.sum([np.frombuffer(x, np.int32) for x in pdf[f"c{i}"]], axis=0, dtype=np.int32).tobytes()] for i in (0, 1)}
        return pd.DataFrame({"block": pdf["block"].iloc[:1], **{k: v for k, v in sums.items()}})

    try:
        n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        n0, n1 = sum(v for k, v in n.items() if k != 1), n.get(1, 0)
        if not n0 or not n1:
            rate = (n1 + 0.5) / (n0 + n1 + 1)
            return Model(np.zeros(size, np.float32), float(np.log(rate / (1 - rate))), orders, bits)
        schema = "block int, c0 binary, c1 binary"
        summed = sample.mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema).collect()
        c0, c1 = (np.concatenate([np.frombuffer(r[k], np.int32) for r in sorted(summed)]).astype(np.float64) for k in ("c0", "c1"))
        ratio = np.log((c1 + laplace) / (c1 + laplace).sum()) - np.log((c0 + laplace) / (c0 + laplace).sum())
        rate = (c0 + c1 + 1) / (n0 + n1 + 2)
        z = (c1 / n1 - c0 / n0) / np.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1))
        kept = np.flatnonzero((c0 + c1 > 0) & (np.abs(z) >= min_z))
        if not len(kept):
            return Model(np.zeros(size, np.float32), float(np.log(n1 / n0)), orders, bits)
        index = np.full(size, -1, np.int32)
        index[kept] = np.arange(len(kept), dtype=np.int32)
        shared = spark.sparkContext.broadcast((index, ratio[kept].astype(np.float32)))

        @F.pandas_udf(VectorUDT())
        def features(texts: pd.Series) -> pd.DataFrame:
            index, scale = shared.value
            places = []
            for _, part in _slices([_normal(t) for t in texts]):
                doc, bucket = _hits(part, orders, bits, index >= 0)
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                for a, b in zip(cuts, cuts[1:]):
                    places.append(index[bucket[a:b]])
            # sparse vectors as they are stored
            return pd.DataFrame({"type": np.int8(0), "size": np.int32(len(scale)), "indices": places, "values": [scale[at].astype(np.float64) for at in places]})

        rows = sample.select(F.col("label").cast("double").alias("label"), features("text").alias("features"))
        fitted = LogisticRegression(maxIter=60, regParam=reg, elasticNetParam=0.0, standardization=False).fit(rows)
        weights = np.zeros(size, np.float32)
        weights[kept] = fitted.coefficients.toArray() * ratio[kept]
        return Model(weights, float(fitted.intercept), orders, bits)
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The probability of label 1 for each whole text, as a column of ``docs``.

    Empty, blank and null texts get the model's constant.  Equal texts get
    equal scores, whatever stands in other columns.
    Texts of any length are scored as a whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        wanted = model.weights != 0
        for texts in batches:
            logit = np.full(len(texts), model.intercept)
            for begin, part in _slices([_normal(t) for t in texts]):
                doc, bucket = _hits(part, model.orders, model.bits, wanted)
                logit[begin : begin + len(part)] += np.bincount(doc, model.weights[bucket], minlength=len(part))
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -500, 500))), index=texts.index)

    return score_texts(text_or_empty(text_col))

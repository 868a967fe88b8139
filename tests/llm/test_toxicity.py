"""The classifier against a plain version: n-grams of characters, ratios, features and scores."""

import math

import numpy as np
import pytest

from sentrylake.llm import toxicity

BITS = 14


def buckets(text):
    """The different buckets of a text's n-grams, by a loop over its characters."""
    t = " " + " ".join(text.lower().split()) + " "
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(t) - n + 1):
            h = ord(t[i])
            for c in t[i + 1 : i + n]:
                h = (h * int(toxicity._BASE) + ord(c)) % 2**32
            out.add(((h ^ (h >> 15) ^ n) * int(toxicity._MIX) % 2**32) >> (32 - BITS))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    words = [f"wört{i}" for i in range(60)] + ["東京", "ça"]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words, 20))
        rows.append((i, text + (" Grässlich foul" if i % 3 == 0 else ""), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return rows, df, toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), bits=BITS)


def test_features_are_those_whose_rates_differ(fitted):
    rows, _, model = fitted
    c, n = [np.zeros(1 << BITS), np.zeros(1 << BITS)], [0, 0]
    for _, text, label in rows:
        n[label] += 1
        for b in buckets(text):
            c[label][b] += 1
    rate = (c[0] + c[1] + 1) / (sum(n) + 2)
    z = (c[1] / n[1] - c[0] / n[0]) / np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    ratio = np.log((c[1] + 1) / (c[1] + 1).sum()) - np.log((c[0] + 1) / (c[0] + 1).sum())
    want = (np.abs(z) >= toxicity.MIN_Z) & (c[0] + c[1] > 0)
    assert want.sum() > 20 and set(np.flatnonzero(model.weights)) <= set(np.flatnonzero(want))
    # the n-grams that only toxic texts have speak for toxicity, by the sign of their ratio
    told = np.flatnonzero(model.weights)
    assert len(told) > 0.9 * want.sum() and (model.weights[told] * ratio[told] ** 2 > 0).mean() > 0.9


def test_scores_are_sums_over_different_ngrams(spark, fitted):
    rows, df, model = fitted
    texts = [r[1] for r in rows[:40]] + ["", " \n", None, "foul foul foul FOUL", "x" * 3000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in got.select("doc_id", toxicity.score(got, model).alias("s")).collect()}
    for i, t in enumerate(texts):
        logit = model.intercept + sum(float(model.weights[b]) for b in buckets(t or ""))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-4)
    assert got[0] > 0.9 > 0.1 > got[1]


def test_one_class_or_no_label_gives_a_constant(spark, fitted):
    _, df, _ = fitted
    docs = df.select("doc_id", "text")
    for labels, low, high in ((df.where("toxic = 1"), 0.9, 1.0), (df.where("false"), 0.4, 0.6), (df.where("toxic = 0"), 0.0, 0.1)):
        model = toxicity.fit(docs, labels.select("doc_id", "toxic"), bits=BITS)
        scores = {r["s"] for r in docs.select(toxicity.score(docs, model).alias("s")).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high

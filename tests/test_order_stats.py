"""Values at ranks against a sort, with few bins and rows so that ranges are cut again and again."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.operators import ml, order_stats, quality

SCHEMA = "g string, score double"


def made(seed):
    draw = random.Random(seed)
    rows = [("even", draw.random()) for _ in range(700)] + [("steep", 10.0 ** draw.uniform(-6, 6) * draw.choice([-1, 1])) for _ in range(500)]
    rows += [("equal", 3.0)] * 400 + [("two", float(i % 2)) for i in range(401)] + [("one", -5.0)] + [("near", 1.0 + k * 2.0**-52) for k in range(300)]
    rows += [("ends", x) for x in [math.inf] * 30 + [-math.inf] * 30 + [float(i) for i in range(200)]]
    return rows + [("even", None), ("even", math.nan), ("none", None)]


@pytest.mark.parametrize("bins, small", [(16, 5), (1_024, 10_000)])
def test_ranks(spark, bins, small):
    rows = made(1)
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    ranks = [(g, r) for g, vs in groups.items() for r in {0, 1, len(vs) // 3, len(vs) // 2, len(vs) - 1, len(vs), -1}]
    out = order_stats.values_at_ranks(spark.createDataFrame(rows, SCHEMA), ["g"], "score", spark.createDataFrame(ranks, "g string, rank long"), bins, small).collect()
    want = {(g, r): sorted(groups[g])[r] for g, r in ranks if 0 <= r < len(groups[g])}
    assert {(r["g"], r["rank"]): r["value"] for r in out} == want and len(out) == len(want)


def test_percentiles(spark):
    rows = [r for r in made(2) if r[0] not in ("steep", "ends")]
    out = order_stats.percentiles(spark.createDataFrame(rows, SCHEMA), ["g"], "score", [0.5, 0.95, 0.99, 0.0, 1.0], 8, 4).collect()
    for r in out:
        v = [x for g, x in rows if g == r["g"] and x is not None and not math.isnan(x)]
        assert r["p"] == pytest.approx(list(np.percentile(v, [50, 95, 99, 0, 100])), rel=1e-12)
    assert {r["g"] for r in out} == {"even", "equal", "two", "one", "near"}


def test_whole_table_and_distribution(spark):
    rows = [r for r in made(3) if r[0] == "even"]
    df = spark.createDataFrame(rows, SCHEMA)
    v = [x for _, x in rows if x is not None and not math.isnan(x)]
    (p,) = order_stats.percentiles(df, [], "score", [0.5, 0.99]).collect()
    assert p["p"] == pytest.approx(list(np.percentile(v, [50, 99])))
    (r,) = quality.score_distribution(df.where("score is not null and not isnan(score)")).collect()
    assert (r["mean"], r["std"], r["p50"], r["p95"]) == pytest.approx((np.mean(v), np.std(v), *np.percentile(v, [50, 95])))
    assert order_stats.percentiles(df.where("false"), ["g"], "score", [0.5]).collect() == []


@pytest.mark.parametrize("contamination", [0.0, 0.05, 0.5, 1.0])
def test_anomalies_at_the_contamination(spark, contamination):
    rows = [(i, (i * 37 % 200) / 200) for i in range(200)]
    out = ml.flag_anomalies(spark.createDataFrame(rows, "event_id long, score double"), contamination).collect()
    ordered = sorted(s for _, s in rows)
    threshold = ordered[max(0, min(199, int(200 * (1 - contamination))))]
    assert {r["event_id"] for r in out if r["anomaly"]} == {i for i, s in rows if s >= threshold} and {r["threshold"] for r in out} == {threshold}


def test_many_different_values(spark):
    """A million different values in one group: bins move between tasks, not values."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7_919, F.lit(1_000_000)) / 7).alias("score"))
    (r,) = order_stats.percentiles(df, ["g"], "score", [0.5, 0.95]).collect()
    assert r["p"] == pytest.approx([499_999.5 / 7, 0.95 * 999_999 / 7])

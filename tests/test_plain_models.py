"""Detectors, features and models against plain versions over whole (small) tables."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sentrylake.operators import detect, ml

EVENT = "event_id long, ts double, host string, dst_port int, process string, bytes_sent long"
STREAMS = ("rate", "ports", "procs", "bytes")


def events(seed, n=2_500, minutes=60):
    """Hosts of different habits; bursts of events, ports and bytes; null hosts, ports and processes."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        minute = draw.randrange(minutes)
        host = draw.choice(["a", "a", "a", "b", "c", None])
        if minute in (33, 50) and draw.random() < 0.8:
            host = "b"
        rows.append((i, minute * 60 + draw.randrange(240) / 4, host, draw.choice([None, *range(4)]) if minute != 50 else draw.randrange(500), draw.choice(["p", "q", None]), draw.choice([None, 10, 20]) if minute != 40 else 50_000))
    return rows


def plain_statistical(rows, warmup, z_threshold=3.5, alpha=0.05, min_buckets=5):
    """A running detector: a state for each host, that of the open minute and the baselines of those before."""
    state, out, snapshots = {}, {}, {}
    for n, (i, ts, host, port, process, size) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        host = host or "__unknown__"
        s = state.setdefault(host, {"minute": None, "seen": 0, "base": None})
        minute = math.floor(ts / 60)
        if minute != s["minute"]:
            if s["minute"] is not None:
                closed = [s["rate"], len(s["ports"]), len(s["procs"]), s["bytes"]]
                s["base"] = [(float(x), 1.0) for x in closed] if not s["seen"] else [(m + alpha * (x - m), (1 - alpha) * (v + alpha * (x - m) ** 2)) for (m, v), x in zip(s["base"], closed)]
                s["seen"] += 1
            s.update(minute=minute, rate=0, ports=set(), procs=set(), bytes=0)
        s["rate"] += 1
        s["ports"] |= {port} - {None}
        s["procs"] |= {process} - {None}
        s["bytes"] += size or 0
        snapshots[host] = (s["seen"], s["base"])
        if n >= warmup and s["seen"] >= min_buckets:
            z = {k: (x - m) / math.sqrt(max(v, 1e-6)) for k, x, (m, v) in zip(STREAMS, (s["rate"], len(s["ports"]), len(s["procs"]), s["bytes"]), s["base"])}
            over = {k: v for k, v in z.items() if v > z_threshold}
            if over:
                out[i] = (max(over.values()), list(over))
    return out, snapshots


@pytest.mark.parametrize("warmup", [1, 300])
def test_statistical_detections(spark, warmup):
    rows = events(1)
    want, _ = plain_statistical(rows, warmup)
    found = detect.statistical_detections(spark.createDataFrame(rows, EVENT).repartition(4), warmup=warmup).collect()
    assert {r["event_id"]: r["streams"] for r in found} == {i: s for i, (_, s) in want.items()} and len(found) == len(want) > 20
    assert all(r["z_max"] == pytest.approx(want[r["event_id"]][0]) and r["score"] == pytest.approx(min(1.0, r["z_max"] / 8)) for r in found)
    assert len({tuple(s) for _, s in want.values()}) > 2


def test_baseline_snapshot(spark):
    rows = events(2)
    _, want = plain_statistical(rows, 1)
    got = detect.baseline_snapshot(detect.minute_buckets(spark.createDataFrame(rows, EVENT))).collect()
    assert {r["host"] for r in got} == set(want)
    for r in got:
        seen, base = want[r["host"]]
        assert r["buckets_observed"] == seen
        assert (r["rate_mean"], r["rate_var"], r["ports_mean"], r["procs_mean"], r["bytes_mean"]) == pytest.approx((*base[0], base[1][0], base[2][0], base[3][0]))


def test_event_features(spark):
    columns = ["event_id", *ml.CATEGORICAL, *ml.NUMERIC, *ml.TEXT]
    draw = random.Random(3)
    rows = []
    for i in range(120):
        words = " ".join(draw.choice(["Ls", "-l", "cat", "/etc/x", "réseau"]) for _ in range(draw.randrange(6)))
        rows.append((i, *(draw.choice(["", None, "x", "y", "ß"]) for _ in ml.CATEGORICAL), *(draw.choice([None, 0, 7, 100_000, -5]) for _ in ml.NUMERIC), words, draw.choice([None, "", "Login  failed\tagain"]), None))
    schema = ", ".join(f"{c} {'long' if c == 'event_id' or c in ml.NUMERIC else 'string'}" for c in columns)
    span = {c: [v for v in (r[columns.index(c)] for r in rows) if v is not None] for c in ml.NUMERIC}
    bucket = lambda v, n: (xxhash.xxh64_intdigest(v.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)

    def plain(r):
        row, out = dict(zip(columns, r)), {}
        for k, c in enumerate(ml.CATEGORICAL):
            if row[c]:
                out[bucket(row[c], 64) % ml.CATEGORY_BUCKETS + k * ml.CATEGORY_BUCKETS] = 1.0
        base = len(ml.CATEGORICAL) * ml.CATEGORY_BUCKETS
        for k, c in enumerate(ml.NUMERIC):
            if row[c] is not None:
                out[base + 2 * k] = (row[c] - min(span[c])) / max(1.0, max(span[c]) - min(span[c]))
                out[base + 2 * k + 1] = math.log1p(abs(row[c]))
        counts = {}
        for t in " ".join(row[c] or "" for c in ml.TEXT).lower().split():
            b = bucket(t, 32) % ml.TEXT_BUCKETS
            counts[b] = counts.get(b, 0) + 1
        norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
        return out | {base + 2 * len(ml.NUMERIC) + b: n / norm for b, n in counts.items()}

    for r in ml.event_features(spark.createDataFrame(rows, schema)).collect():
        got = {f["index"]: f["value"] for f in r["features"]}
        assert len(got) == len(r["features"]) and got == pytest.approx(plain(rows[r["event_id"]]))


def test_reconstruction_error(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 5)) + 0.05 * rng.normal(size=(300, 5))
    x[7] += np.array([3, -3, 3, -3, 3])
    out = {r["event_id"]: r for r in ml.reconstruction_error(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "event_id long, x array<double>")).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    basis = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[2][:2].T
    error = ((z - z @ basis @ basis.T) ** 2).mean(axis=1)
    low, high = np.percentile(error, [95, 99])
    assert [out[i]["error"] for i in range(300)] == pytest.approx(error.tolist(), rel=1e-6, abs=1e-9)
    assert [out[i]["score"] for i in range(300)] == pytest.approx(np.clip((error - low) / (high - low), 0, 1).tolist(), rel=1e-5, abs=1e-7)
    assert max(out.values(), key=lambda r: r["error"])["event_id"] == 7


def test_token_embeddings(spark):
    """Words of one kind of document lie nearer to each other than to those of another kind, in one task and in several."""
    draw = random.Random(5)
    kinds = [[f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]]
    docs = spark.createDataFrame([([draw.choice(kinds[k % 2]) for _ in range(30)],) for k in range(400)], "tokens array<string>").repartition(4)
    for partitions in (None, 2):
        rows = ml.fit_token_embeddings(docs, size=10, partitions=partitions).collect()
        vector = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in rows}
        assert set(vector) == {*kinds[0], *kinds[1]}
        near = np.mean([vector[a] @ vector[b] for k in kinds for a in k for b in k if a != b])
        far = np.mean([vector[a] @ vector[b] for a in kinds[0] for b in kinds[1]])
        assert near > far + 0.3, (near, far)


def test_positional_documents(spark):
    """M06 against numpy: means of known words' vectors and waves of their place among known words."""
    vectors = {"x": [1.0, 2.0, 3.0], "y": [0.5, -1.0, 4.0]}
    docs = {1: ["x", "unknown", "y", "x"], 2: ["unknown"], 3: []}
    got = ml.embed_documents(spark.createDataFrame(list(docs.items()), "node long, tokens array<string>"), spark.createDataFrame(list(vectors.items()), "word string, vector array<double>"), 3).collect()
    wave = lambda p: np.array([(np.sin if i % 2 == 0 else np.cos)(p * 10_000 ** (-(i - i % 2) / 3)) for i in range(3)])
    known = [w for w in docs[1] if w in vectors]
    want = {1: np.mean([np.array(vectors[w]) + wave(p) for p, w in enumerate(known)], axis=0), 2: np.zeros(3), 3: np.zeros(3)}
    assert len(got) == 3 and all(r["x"] == pytest.approx(want[r["node"]].tolist()) for r in got)

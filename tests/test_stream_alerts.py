"""Alerts of a stream against the batch form, however the input is cut and shuffled; and what stays in the state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import store, triage
from sentrylake.streaming import alerts

SCHEMA = "fingerprint string, event_id long, event_time timestamp, severity string, score double, host string, suppressed boolean"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def made(seed, n=600, span=200_000):
    draw = random.Random(seed)
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [(draw.choice(["hot", "hot", "a", "b"]), i, at(draw.randrange(0, span * 4) / 4), draw.choice(["low", "high", "critical"]), draw.random(), draw.choice([f"h{draw.randrange(40)}", None]), draw.random() < 0.05) for i in range(n)]
    return sorted(rows, key=lambda r: r[2])


def shuffled(rows, batches, seed):
    """Rows in batches, each a little out of order with its neighbours."""
    draw = random.Random(seed)
    order = sorted(rows, key=lambda r: r[2].timestamp() + draw.uniform(-1_000, 1_000))
    size = -(-len(order) // batches)
    return [draw.sample(order[i : i + size], len(order[i : i + size])) for i in range(0, len(order), size)]


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a query over batches, then over rows far ahead that let the watermark pass; its rows and the state's size after each batch."""

    def go(build, batches, name):
        folder, beat = f"{tmp_path}/{name}-in", START + datetime.timedelta(days=400)
        ahead = [[(f"beat{i}", -1, beat + datetime.timedelta(days=i), "low", 0.0, None, False)] for i in range(2)]
        sizes = []
        for rows in [*batches, *ahead]:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            q = build(spark.readStream.schema(SCHEMA).parquet(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
            q.awaitTermination()
            sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        return [r for r in spark.read.parquet(f"{tmp_path}/{name}-out").collect() if r["event_id"] >= 0], sizes

    return go


def batch_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.unix_micros("event_time") / F.lit(1e6))


def test_escalations_as_in_a_batch(spark, stream):
    rows = made(1)
    df = batch_of(spark, rows)
    suppressed = F.col("suppressed")
    want = triage.escalations(triage.triage_sessions(df, 3_600.0, suppressed=suppressed), suppressed=suppressed).collect()
    begin = {}
    for r in want:
        begin[r["fingerprint"], r["session"]] = min(r["ts"], begin.get((r["fingerprint"], r["session"]), r["ts"]))
    want = sorted((r["event_id"], begin[r["fingerprint"], r["session"]], r["priority"], r["is_new"], bool(r["escalated"]), r["forwarded"]) for r in want)
    got, sizes = stream(lambda s: alerts.stream_alerts(s, 3_600.0), shuffled(rows, 4, 2), "x03")
    assert sorted((r["event_id"], r["session_start"], r["priority"], r["is_new"], r["escalated"], r["forwarded"]) for r in got) == want
    assert any(r[4] for r in want) and any(not r[5] and r[3] for r in want)
    # waiting rows, sums and timers of all keys but those of the heartbeat are gone
    assert sizes[-1] < max(sizes[:-2]) / 4, sizes


def test_limits_as_in_a_batch(spark, stream):
    rows = made(3, 400, 6_000)
    want = store.rate_limited(batch_of(spark, rows), 2, "fingerprint").collect()
    got, sizes = stream(lambda s: alerts.stream_rate_limit(s, 2, "fingerprint", "1 hour"), shuffled(rows, 3, 4), "w13")
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(not r["admitted"] for r in want) and sizes[-1] < max(sizes[:-2]) / 4, sizes


def test_priority_of_a_row_is_that_of_columns(spark):
    draw = random.Random(5)
    cases = [(draw.randrange(4), draw.choice([1, 2, 50, 100, 101, 500]), draw.randrange(30), draw.random()) for _ in range(300)]
    df = spark.createDataFrame(cases, "peak int, count long, hosts long, top double").withColumn("severity", F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), F.col("peak") + 1))
    band = triage.priority_band(triage.priority_score(F.col("severity"), F.col("count"), F.col("hosts"), F.lit(False), F.col("top")))
    assert all(r["b"] == alerts._priority(r["peak"], r["count"], r["hosts"], r["top"]) for r in df.withColumn("b", band).collect())


def test_rows_wait_in_chunks_of_keys_that_share_a_bucket(spark, stream, monkeypatch):
    monkeypatch.setattr(alerts, "BUCKETS", 4, raising=False)
    monkeypatch.setattr(alerts, "CHUNK", 100, raising=False)
    rows = [(f"k{r[1] % 150}", *r[1:]) for r in made(7)]
    df, suppressed = batch_of(spark, rows), F.col("suppressed")
    want = triage.escalations(triage.triage_sessions(df, 3_600.0, suppressed=suppressed), suppressed=suppressed).collect()
    got, sizes = stream(lambda s: alerts.stream_alerts(s, 3_600.0, late="40 days"), shuffled(rows, 2, 8), "chunks")
    assert sorted((r["event_id"], r["priority"], r["is_new"], r["forwarded"]) for r in got) == sorted((r["event_id"], r["priority"], r["is_new"], r["forwarded"]) for r in want)
    # the state had at least a row for each of 150 keys
    assert max(sizes) < 100, sizes

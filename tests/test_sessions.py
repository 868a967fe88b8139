"""Sessions in slices of time against the window form, and limits between silences."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentrylake.functions.sessions import sessionize
from sentrylake.operators import store, triage

SCHEMA = "event_id long, ts double, fingerprint string, severity string"


def made(seed, n=3_000):
    draw = random.Random(seed)
    rows = [(i, float(draw.randrange(0, 400_000, 50)), draw.choice(["hot"] * 2 + ["b", "c", None] + [f"k{draw.randrange(300)}"]), "high") for i in range(n)]
    # gaps that equal the window, and negative times
    rows += [(n + i, -10_000.0 + i * 3_600, "edge", "low") for i in range(10)] + [(n + 100, 5.0, "one", "low"), (n + 101, 5.0, "one", "low")]
    return rows


@pytest.mark.parametrize("slice_seconds", [None, 10.0, 3_600.0, 50_000.0])
def test_as_the_window_form(spark, slice_seconds):
    df = spark.createDataFrame(made(1), SCHEMA)
    order = Window.partitionBy("fingerprint").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(order) > 3_600).cast("long"), F.lit(1))
    want = df.withColumn("session", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = sessionize(df, ["fingerprint"], 3_600.0, ["ts", "event_id"], slice_seconds=slice_seconds)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_without_a_time_and_closed_sessions(spark):
    rows = [(1, None, "a", "x"), (2, None, "a", "x"), (3, 10.0, "a", "x"), (4, 20.0, "a", "end"), (5, 21.0, "a", "x"), (6, 9_000.0, "a", "end"), (7, 9_001.0, "a", "x")]
    for width in (None, 5.0, 1e9):
        out = sessionize(spark.createDataFrame(rows, SCHEMA), ["fingerprint"], 3_600.0, ["ts", "event_id"], slice_seconds=width, ends=F.col("severity") == "end").collect()
        assert {r["event_id"]: r["session"] for r in out} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4, 7: 5}


def test_triage_takes_repeats_once(spark):
    df = spark.createDataFrame(made(2) + made(2)[:500], SCHEMA)
    assert triage.triage_sessions(df).count() == len(made(2))
    assert triage.triage_sessions(df.where("false")).collect() == []


def test_a_hot_key_takes_many_tasks(spark):
    """A fingerprint with a third of the rows: no group of rows that is sorted together is much above the others."""
    df = spark.range(60_000).select(F.col("id").alias("event_id"), (F.col("id") * 10.0).alias("ts"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("fingerprint"), F.lit("high").alias("severity"))
    out = triage.triage_sessions(df).withColumn("slice", F.floor(F.col("ts") / 900))
    largest = out.groupBy("fingerprint", "slice").count().agg(F.max("count")).first()[0]
    assert largest <= 60_000 / 3 / 600
    assert out.where("fingerprint = 'hot'").agg(F.countDistinct("session")).first()[0] == 1


@pytest.mark.parametrize("per_minute", [1, 3])
def test_limits_between_silences(spark, per_minute):
    draw = random.Random(per_minute)
    rows = [(i, float(draw.randrange(0, 9_000)), draw.choice("ab"), "high") for i in range(400)]
    want, lost = {}, 0
    for key in "ab":
        admitted, before, lost = deque(), None, 0
        for i, t, _, _ in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0])):
            lost = 0 if before is None or t - before > 60 else lost
            while admitted and admitted[0] < t - 60:
                admitted.popleft()
            ok = len(admitted) < per_minute
            if ok:
                admitted.append(t)
            lost, before = lost + (not ok), t
            want[i] = (ok, lost)
    out = store.rate_limited(spark.createDataFrame(rows, SCHEMA), per_minute, "fingerprint").collect()
    assert {r["event_id"]: (r["admitted"], r["dropped"]) for r in out} == want and len(out) == len(rows)

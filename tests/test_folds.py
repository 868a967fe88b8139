"""Folds over many small groups, null keys and groups that span batches."""

import pandas as pd

from sentrylake.functions.folds import ordered_fold
from sentrylake.operators import triage


def test_as_a_running_sum(spark):
    def totals():
        state = 0

        def step(rows):
            nonlocal state
            out = []
            for v in rows["v"]:
                state += v
                out.append(state)
            return {"k": rows["k"], "v": rows["v"], "total": out}

        return step

    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(400).selectExpr("CASE WHEN id % 23 > 0 THEN concat('k', id % 23 * (id % 2)) END AS k", "id AS v")
        got = [tuple(r) for r in ordered_fold(rows, ["k"], ["v"], "k string, v long, total long", totals).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want, sums = [], {}
    for k, v in sorted(map(tuple, rows.collect()), key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        want.append((k, v, sums[k]))
    key = lambda r: r[1]
    assert sorted(got, key=key) == want


def test_small_groups_make_no_frame_each(spark, monkeypatch):
    """A frame for each batch, not for each case: the fold's own lists are what a case costs."""
    seen = []

    def fold():
        def step(rows):
            seen.append(type(rows["v"]))
            return {"k": rows["k"], "v": rows["v"]}

        return step

    made = []
    frame = spark.range(1)
    monkeypatch.setattr(type(frame), "repartition", lambda self, *_: self)
    monkeypatch.setattr(type(frame), "sortWithinPartitions", lambda self, *_: self)
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, run, schema: made.append(run) or self)
    ordered_fold(frame, ["k"], ["v"], "k long, v long", fold)
    out = list(made[0](iter([pd.DataFrame({"k": range(1_000), "v": range(1_000)})])))
    assert len(out) == 1 and len(out[0]) == 1_000 and set(seen) == {list}


def test_a_changed_entry_is_found(spark):
    rows = spark.range(3_000).selectExpr("concat('c', id % 900) AS case_id", "id * 1.0D AS ts", "'a' AS action", "'u' AS actor", "CASE WHEN id % 5 = 0 THEN NULL ELSE 'd' END AS detail")
    log = triage.append_custody(rows)
    assert triage.verify_custody(log).where("valid").count() == 900
    assert log.groupBy("case_id").agg({"seq": "max"}).where("`max(seq)` between 3 and 4").count() == 900

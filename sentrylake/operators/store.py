"""Aggregates, lists and retention over stored events, detections and incidents."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folds import ordered_fold
from ..functions.sessions import sessionize
from ..functions.severity import SEVERITIES, at_least


def in_range(df: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    """Rows from ``since`` to ``until``, both included, by ts."""
    if since is not None:
        df = df.where(F.col("ts") >= since)
    return df if until is None else df.where(F.col("ts") <= until)


def detections_histogram(detections: DataFrame, since: float, until: float, bin_seconds: float) -> DataFrame:
    """(bin, bin_ts, count, low .. critical) of every bin of the range, empty ones too.

    Counts are summed in each task before the shuffle; the bins are made by
    Spark and joined, so a range of any length is possible.
    """
    import math

    bins = max(1, math.ceil(max(0.0, until - since) / bin_seconds))
    at = F.floor((F.col("ts") - since) / bin_seconds)
    counted = (
        in_range(detections, since, until)
        .groupBy(at.alias("bin"))
        .agg(F.count("*").alias("count"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
        .where(F.col("bin") < bins)
    )
    every = detections.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(float(since)) + F.col("bin") * float(bin_seconds)).alias("bin_ts"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("count", *SEVERITIES))
    )


def top_counts(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent values that are not null, ties to the lesser."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), col).limit(n)


def severity_breakdown(detections: DataFrame) -> DataFrame:
    """The count of every severity, those without a detection too."""
    counts = detections.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    rows = F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("count")) for s in SEVERITIES))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    """Rows for each value."""
    return df.groupBy(*cols).agg(F.count("*").alias("count"))


def counts_by_each(df: DataFrame, *cols: str) -> DataFrame:
    """(dimension, value, count): grouping sets of single columns and of nothing (total), in one pass."""
    values = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols), F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value")))
    return df.select(F.explode(values).alias("v")).groupBy("v.dimension", "v.value").agg(F.count("*").alias("count"))


def store_stats(**tables: DataFrame) -> DataFrame:
    """(table, rows, first_ts, last_ts) of each table."""
    parts = [df.agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(events: DataFrame, detections: DataFrame, since: float, until: float) -> DataFrame:
    """Totals of a period, detections an hour, and detections for each event."""
    hours = max((until - since) / 3600, 1e-9)
    e = in_range(events, since, until).agg(F.count("*").alias("events"), F.countDistinct("host").alias("hosts"))
    d = in_range(detections, since, until).agg(F.count("*").alias("detections"))
    return e.join(d).select(
        "events", "detections", "hosts", (F.col("detections") / F.lit(hours)).alias("detections_per_hour"),
        F.when(F.col("events") > 0, F.col("detections") / F.col("events")).otherwise(F.lit(0.0)).alias("alert_ratio"),
    )


def score_summary(detections: DataFrame) -> DataFrame:
    """The mean of the scores that are not zero, and the greatest, for each detector."""
    return detections.groupBy("detector").agg(F.count("*").alias("count"), F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("mean_score"), F.max("score").alias("max_score"))


def trend_direction(detections: DataFrame, since: float, until: float, bins: int = 12) -> DataFrame:
    """(first_half, second_half, direction): increasing from 1.25 times the first half's count, decreasing to 0.75 of it."""
    half = since + (until - since) / bins * (bins // 2)
    counts = in_range(detections, since, until).agg(F.count_if(F.col("ts") < half).alias("first_half"), F.count_if(F.col("ts") >= half).alias("second_half"))
    a, b = F.col("first_half"), F.col("second_half")
    return counts.withColumn("direction", F.when(b > a * 1.25, "increasing").when(b < a * 0.75, "decreasing").otherwise("stable"))


def newest(df: DataFrame, n: int, where: Column | None = None, offset: int = 0, order: Sequence[Column | str] = ()) -> DataFrame:
    """A page of a list, newest first unless another order is given."""
    rows = df if where is None else df.where(where)
    rows = rows.orderBy(*(order or (F.desc("ts"), F.desc("event_id"))))
    return (rows.offset(offset) if offset else rows).limit(n)


#: Days that detections of each severity are kept.
RETENTION_DAYS = {"low": 7, "medium": 30, "high": 90, "critical": 365}


def retain(df: DataFrame, now: float, days: float | Mapping[str, float] = RETENTION_DAYS) -> DataFrame:
    """rows that are young enough, by one limit or by one for each severity; others of no known severity stay."""
    age = F.lit(float(now)) - F.col("ts")
    if not isinstance(days, Mapping):
        return df.where(age <= days * 86400.0)
    limit = F.lit(None).cast("double")
    for severity, n in days.items():
        limit = F.when(F.col("severity") == severity, F.lit(n * 86400.0)).otherwise(limit)
    return df.where(F.coalesce(age <= limit, F.lit(True)))


#: Rows of a part in which arriving and stored keys meet, about.
APPEND_ROWS = 500_000


def append_new(stored: DataFrame, arriving: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The arriving rows whose key is not stored, one for each key (of several the least by all columns).

    Both are counted and dealt by key to as many parts as they need, so a task
    sorts about ``APPEND_ROWS`` rows whatever the input; stored keys are not broadcast.
    """
    key = [key] if isinstance(key, str) else list(key)
    parts = max(1, math.ceil((arriving.count() + stored.count()) / APPEND_ROWS))
    rest = [F.col(c) for c in arriving.columns if c not in key]
    # the order of the window serves the join too
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or key)))
    fresh = arriving.repartition(parts, *key).withColumn("_n", first).where("_n = 1").drop("_n")
    return fresh.join(stored.select(*key).repartition(parts, *key).hint("merge"), key, "left_anti")


def detection_uid() -> Column:
    """event_id:detector."""
    return F.concat_ws(":", F.col("event_id").cast("string"), "detector")


#: Seconds for which an admitted alert counts.
MINUTE = 60.0


def admissions(per_minute: int) -> Callable[[float], bool]:
    """A function of times in order: whether each is admitted.  It keeps the last admitted times only, at most ``per_minute`` of them."""
    admitted: deque[float] = deque()

    def admit(t: float) -> bool:
        while admitted and admitted[0] < t - MINUTE:
            admitted.popleft()
        if len(admitted) >= per_minute:
            return False
        admitted.append(t)
        return True

    return admit


def rate_limited(alerts: DataFrame, per_minute: int, key: str, min_severity: str = "low") -> DataFrame:
    """(key, event_id, admitted, dropped): alerts at or above the floor, whether each is admitted, and how many its key has lost since its last silence.

    An alert is admitted if fewer than ``per_minute`` of its key were
    admitted in the 60 seconds before, both ends included.  What is admitted
    depends on what was before, but not beyond a silence of over 60 seconds:
    a key's alerts are cut there (in slices of time, so a hot key takes many
    tasks) and each run between two silences is folded in order, in one pass.
    """
    kept = alerts.where(at_least(F.col("severity"), min_severity)).select(F.col(key).alias("key"), "ts", "event_id")
    runs = sessionize(kept, ["key"], MINUTE, ["ts", "event_id"], "run")

    def fold():
        admit, lost = admissions(per_minute), 0

        def step(rows: dict[str, list]) -> dict[str, list]:
            nonlocal lost
            taken, dropped = [], []
            for t in rows["ts"]:
                taken.append(admit(t))
                lost += not taken[-1]
                dropped.append(lost)
            return {"key": rows["key"], "event_id": rows["event_id"], "admitted": taken, "dropped": dropped}

        return step

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    folded = ordered_fold(runs, ["key", "run"], ["ts", "event_id"], f"key {kinds['key']}, event_id {kinds['event_id']}, admitted boolean, dropped long", fold)
    return folded.select(F.col("key").alias(key), "event_id", "admitted", "dropped")


def incident_history(snapshots: DataFrame, incident_id: str) -> DataFrame:
    """An incident's snapshots in order of time."""
    return snapshots.where(F.col("incident_id") == incident_id).orderBy("ts", "snapshot")


#: The default schedules (name, kind of report, seconds between runs, seconds looked back).
SCHEDULES = (
    ("Daily Executive Report", "executive", 86_400.0, 86_400.0),
    ("Weekly Compliance Report", "compliance", 604_800.0, 604_800.0),
    ("Hourly Operational Report", "operational", 3_600.0, 3_600.0),
)


def scheduled_reports(events: DataFrame, detections: DataFrame, now: float, last_runs: Mapping[str, float] | None = None, schedules: Sequence[tuple[str, str, float, float]] = SCHEDULES) -> DataFrame:
    """One row for each schedule that is due: (schedule, kind, since, until, next_run, events, detections, hosts, critical).

    A schedule is due if it never ran (``last_runs`` by name) or its interval has
    passed.  All due reports come from one pass over either table: a row
    counts for each period that it lies in.
    """
    due = [s for s in schedules if s[0] not in (last_runs or {}) or now >= last_runs[s[0]] + s[2]]
    columns = "schedule string, kind string, since double, until double, next_run double"
    table = events.sparkSession.createDataFrame([(name, kind, now - back, now, now + every) for name, kind, every, back in due], columns)
    ts = F.col("ts")
    spans = F.array_compact(F.array(*(F.when((ts >= now - back) & (ts <= now), F.lit(name)) for name, _, _, back in due), F.lit(None).cast("string")))
    seen = events.select(F.explode(spans).alias("schedule"), "host").groupBy("schedule").agg(F.count("*").alias("events"), F.countDistinct("host").alias("hosts"))
    found = detections.select(F.explode(spans).alias("schedule"), "severity").groupBy("schedule").agg(F.count("*").alias("detections"), F.count_if(F.col("severity") == "critical").alias("critical"))
    joined = table.join(seen, "schedule", "left").join(found, "schedule", "left")
    return joined.select("schedule", "kind", "since", "until", "next_run", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "detections", "hosts", "critical")))

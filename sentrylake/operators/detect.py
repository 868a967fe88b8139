"""Ensembles and per-host statistical baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folds import ordered_fold
from ..functions.severity import severity_from_score

#: Stands behind every minute, for the state after the last one.
LAST_MINUTE = 2**62


def ensemble(
    hits: DataFrame,
    strategy: str = "weighted_mean",
    weights: Mapping[str, float] | None = None,
    detectors: int | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """One row for each event from its detectors' hits (event_id, detector, score, tags, reasons).

    weighted_mean weighs each hit (1 unless given), max takes the best,
    majority needs more than half of ``detectors`` and takes the mean.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("detector") == name, F.lit(float(w))).otherwise(weight)
    score = F.col("score")
    if strategy == "max":
        combined = F.max(score)
    elif strategy == "majority":
        combined = F.when(F.count("*") >= max(1, (detectors or 1) // 2 + 1), F.avg(score)).otherwise(F.lit(0.0))
    elif strategy == "weighted_mean":
        combined = F.when(F.sum(weight) > 0, F.sum(weight * score) / F.sum(weight)).otherwise(F.lit(0.0))
    else:
        raise ValueError(strategy)
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags"))))
    out = hits.groupBy("event_id").agg(combined.alias("score"), F.array_sort(F.collect_set("detector")).alias("components"), tags.alias("tags"))
    return out.where((F.col("score") > 0) & (F.col("score") >= threshold)).withColumn("severity", severity_from_score(F.col("score")))


STREAMS = ("rate", "ports", "procs", "bytes")


def minute_counters(events: DataFrame) -> DataFrame:
    """Events with the running figures of their host and minute: rate, different ports and processes, bytes.

    Ordered by (ts, event_id); a running count of different values is the
    running sum of their first occurrences, so nothing is collected.
    """
    keyed = events.withColumn("host", F.coalesce("host", F.lit("__unknown__"))).withColumn("minute", F.floor(F.col("ts") / 60).cast("long"))
    group = Window.partitionBy("host", "minute").orderBy("ts", "event_id")
    running = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def first(col: str) -> Column:
        order = Window.partitionBy("host", "minute", col).orderBy("ts", "event_id")
        return ((F.row_number().over(order) == 1) & F.col(col).isNotNull()).cast("int")

    marked = keyed.withColumn("_port", first("dst_port")).withColumn("_proc", first("process"))
    return (
        marked.withColumn("rate", F.count("*").over(running))
        .withColumn("ports", F.sum("_port").over(running))
        .withColumn("procs", F.sum("_proc").over(running))
        .withColumn("bytes", F.sum(F.coalesce("bytes_sent", F.lit(0))).over(running))
        .drop("_port", "_proc")
    )


def minute_buckets(events: DataFrame) -> DataFrame:
    """(host, minute, rate, ports, procs, bytes) of every minute in which a host had events."""
    host, minute = F.coalesce("host", F.lit("__unknown__")).alias("host"), F.floor(F.col("ts") / 60).cast("long").alias("minute")
    return events.groupBy(host, minute).agg(
        F.count("*").alias("rate"), F.countDistinct("dst_port").alias("ports"), F.countDistinct("process").alias("procs"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes")
    )


def ewma_baseline(buckets: DataFrame, alpha: float = 0.05, streams: Sequence[str] = STREAMS) -> DataFrame:
    """(host, minute, seen, <stream>_mean, <stream>_var): the baseline before each minute of a host.

    A host's minutes are folded in order, one row for a minute that had
    events, with the state carried and nothing else held.  The first minute
    sets the mean and a variance of 1.  A last row, of no minute, holds the
    state after all of them.
    """
    values = [f"{s}_{p}" for s in streams for p in ("mean", "var")]

    def fold():
        state = {"seen": 0, "mean": np.zeros(len(streams)), "var": np.ones(len(streams))}

        def step(rows: dict[str, list]) -> dict[str, list]:
            xs, n = np.array([rows[s] for s in streams], np.float64).T, len(rows["minute"])
            out = np.empty((n, 2 * len(streams)))
            seen, mean, var = state["seen"], state["mean"], state["var"]
            for i in range(n):
                out[i, ::2], out[i, 1::2] = mean, var
                if seen + i == 0:
                    mean, var = xs[i], np.ones(len(streams))
                else:
                    delta = xs[i] - mean
                    mean, var = mean + alpha * delta, (1 - alpha) * (var + alpha * delta * delta)
            state.update(seen=seen + n, mean=mean, var=var)
            return {"host": rows["host"], "minute": rows["minute"], "seen": range(seen, seen + n)} | dict(zip(values, out.T.tolist()))

        return step

    # a row behind the last minute asks for the state after it
    last = buckets.select("host").distinct().select("host", F.lit(LAST_MINUTE).alias("minute"), *(F.lit(0.0).alias(s) for s in streams))
    rows = buckets.select("host", F.col("minute").cast("long").alias("minute"), *(F.col(s).cast("double").alias(s) for s in streams)).unionByName(last)
    folded = ordered_fold(rows, ["host"], ["minute"], "host string, minute long, seen int, " + ", ".join(f"{v} double" for v in values), fold)
    return folded.withColumn("minute", F.nullif("minute", F.lit(LAST_MINUTE)))


def baseline_snapshot(buckets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Each host's baseline after its last minute but one, as a running detector holds it while the last is open."""
    states = ewma_baseline(buckets, alpha).where("minute is not null")
    newest = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("minute")))
    return states.withColumn("_n", newest).where("_n = 1").select("host", "rate_mean", "rate_var", "ports_mean", "procs_mean", "bytes_mean", F.col("seen").alias("buckets_observed"))


def statistical_detections(events: DataFrame, z_threshold: float = 3.5, warmup: int = 200, saturation: float = 8.0, min_buckets: int = 5, alpha: float = 0.05) -> DataFrame:
    """Events whose running figures lie above their host's baseline of earlier minutes.

    The first ``warmup`` - 1 events of all hosts together are silent; the
    cutoff is one row, found by a limit.  (event_id, host, ts, score, severity, z_max, streams)
    """
    counters = minute_counters(events).select("event_id", "host", "minute", "ts", *STREAMS)
    base = ewma_baseline(minute_buckets(events), alpha).where(F.col("minute").isNotNull() & (F.col("seen") >= min_buckets))
    cutoff = events.select(F.struct("ts", "event_id").alias("c")).orderBy("c").limit(warmup).agg(F.max("c").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") >= warmup)
    z = {s: (F.col(s) - F.col(f"{s}_mean")) / F.sqrt(F.greatest(F.col(f"{s}_var"), F.lit(1e-6))) for s in STREAMS}
    over = {s: F.when(z[s] > z_threshold, z[s]) for s in STREAMS}
    found = counters.join(base, ["host", "minute"]).join(F.broadcast(cutoff)).where(F.struct("ts", "event_id") >= F.col("cutoff"))
    found = found.withColumn("z_max", F.greatest(*over.values())).where("z_max is not null")
    score = F.least(F.lit(1.0), F.col("z_max") / saturation)
    streams = F.array_compact(F.array(*(F.when(over[s].isNotNull(), F.lit(s)) for s in STREAMS)))
    return found.select("event_id", "host", "ts", score.alias("score"), severity_from_score(score).alias("severity"), "z_max", streams.alias("streams"))

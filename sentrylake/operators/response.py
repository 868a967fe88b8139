"""Playbooks, lookups of incidents, lists, registries and retraining."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import at_least
from .quality import DRIFT_SEVERITIES


def condition(field: Column, op: str, value: Any, is_array: bool = False) -> Column:
    """one playbook condition; null fields do not match, but for ``!=``."""
    ops = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}
    if op in ops:
        return F.coalesce(getattr(field, ops[op])(F.lit(value)), F.lit(op == "!="))
    if op == "in":
        return F.coalesce(field.isin(*value), F.lit(False))
    if op == "contains":
        return F.coalesce(F.array_contains(field, value) if is_array else field.contains(value), F.lit(False))
    return F.lit(False)


def playbook_applies(playbook: Mapping[str, Any], arrays: Sequence[str] = ("tags",)) -> Column:
    """enabled, any of the required tags, severity at least the floor, and all conditions."""
    parts = [F.lit(bool(playbook.get("enabled", True)))]
    if playbook.get("tags_required"):
        parts.append(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, playbook["tags_required"]))), F.lit(False)))
    if playbook.get("min_severity"):
        parts.append(at_least(F.col("severity"), playbook["min_severity"].lower()))
    parts += [condition(F.col(c["field"]), c.get("op", "=="), c.get("value"), c["field"] in arrays) for c in playbook.get("conditions", ())]
    return functools.reduce(Column.__and__, parts)


def match_playbooks(rows: DataFrame, playbooks: Sequence[Mapping[str, Any]], key: str = "event_id") -> DataFrame:
    """(key, playbook_id, step, action): a row for each step of each playbook that applies, in one pass and without a join."""
    hits = F.array_compact(
        F.array(*(F.when(playbook_applies(p), F.struct(F.lit(p["playbook_id"]).alias("playbook_id"), F.array(*map(F.lit, p["steps"])).alias("steps"))) for p in playbooks))
    )
    each = rows.select(key, F.explode(hits).alias("p"))
    return each.select(key, "p.playbook_id", F.posexplode("p.steps").alias("step", "action"))


def incident_detections(incidents: DataFrame, detections: DataFrame) -> DataFrame:
    """The detections of each incident; incidents: (incident_id, detection_ids)."""
    ids = incidents.select("incident_id", F.explode("detection_ids").alias("event_id"))
    return ids.join(detections, "event_id")


def retrain_decision(drift: DataFrame, elapsed: float, interval: float, min_severity: str = "medium", min_samples: int = 100) -> DataFrame:
    """Drift rows with a reason: scheduled if the interval is over, drift_detected if triggered, severe enough and of enough samples."""
    due = F.lit(interval > 0 and elapsed >= interval)
    severe = F.col("severity").isin(*DRIFT_SEVERITIES[DRIFT_SEVERITIES.index(min_severity) :])
    drifted = F.col("triggered") & severe & (F.col("current_size") >= min_samples)
    return drift.withColumn("reason", F.when(due, "scheduled").when(drifted, "drift_detected").otherwise("none"))


def registry_summary(versions: DataFrame) -> DataFrame:
    """(model_id, versions, production, latest_status) from (model_id, version, status)."""
    return versions.groupBy("model_id").agg(
        F.count("*").alias("versions"), F.max(F.when(F.col("status") == "production", F.col("version"))).alias("production"), F.max_by("status", "version").alias("latest_status")
    )


def edge_set_metrics(explained: DataFrame, edges: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn) of explained edges; an edge is true if both ends are in truth (node) or it is listed in pairs (src, dst)."""
    t = truth.select("node").distinct()
    marked = (
        edges.select("src", "dst").distinct()
        .join(t.select(F.col("node").alias("src"), F.lit(True).alias("a")), "src", "left").join(t.select(F.col("node").alias("dst"), F.lit(True).alias("b")), "dst", "left")
        .join(pairs.select("src", "dst", F.lit(True).alias("c")).distinct(), ["src", "dst"], "left").join(explained.select("src", "dst", F.lit(True).alias("e")).distinct(), ["src", "dst"], "left")
    )
    true = F.coalesce(F.col("a") & F.col("b"), F.lit(False)) | F.coalesce("c", F.lit(False))
    e = F.coalesce("e", F.lit(False))
    return marked.agg(F.count_if(e & true).alias("tp"), F.count_if(e & ~true).alias("fp"), F.count_if(~e & true).alias("fn"), F.count_if(~e & ~true).alias("tn"))


def hunt_section(runs: DataFrame) -> DataFrame:
    """(hunts, runs, hits) over hunt runs (hunt_id, matched)."""
    return runs.agg(F.countDistinct("hunt_id").alias("hunts"), F.count("*").alias("runs"), F.coalesce(F.sum("matched"), F.lit(0)).alias("hits"))

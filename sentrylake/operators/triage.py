"""Alerts: fingerprints, suppression, sessions, priority; kill chains and incidents; cases."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folds import ordered_fold
from ..functions.sessions import sessionize
from ..functions.severity import SEVERITIES, severity_from_score, severity_of_rank, severity_rank

#: The fields that tell alerts of a type apart, in order.
KEY_FIELDS = {
    "process": ("process",),
    "network": ("dst_ip", "dst_port", "protocol"),
    "file": ("file_path", "action"),
    "auth": ("user", "status"),
    "syscall": ("process", "action"),
    "audit": ("action",),
    "unknown": (),
}


def alert_fingerprint(extra: Sequence[str] = ()) -> Column:
    """16 hex digits of SHA-1 over detector, the type's fields and the type; the host is left out."""

    def digest(kind: str, fields: Sequence[str]) -> Column:
        names = ("detector", *fields, *(f for f in extra if f not in fields and f != "detector"))
        parts = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names]
        return F.substring(F.sha1(F.concat_ws("|", *parts, F.lit(f"type={kind}"))), 1, 16)

    out = digest("unknown", ())
    for kind, fields in KEY_FIELDS.items():
        out = F.when(F.col("event_type") == kind, digest(kind, fields)).otherwise(out)
    return out


def alert_title() -> Column:
    """Severity, detector and type, then the first of the type's fields that has a value."""
    detail = F.lit(None).cast("string")
    for kind, fields in KEY_FIELDS.items():
        named = [F.when(F.col(f).cast("string") != "", F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in fields]
        if named:
            detail = F.when(F.col("event_type") == kind, F.coalesce(*named)).otherwise(detail)
    return F.concat_ws(" ", F.concat(F.initcap("severity"), F.lit(":")), "detector", "event_type", F.lit("activity"), detail)


#: Gap of a session, and the samples that an alert keeps.
DEDUP_WINDOW, MAX_IDS, MAX_REASONS = 3600.0, 50, 8


def triage_sessions(detections: DataFrame, window: float = DEDUP_WINDOW, slice_seconds: float | None = None, suppressed: Column | None = None) -> DataFrame:
    """Detections with their session: one of a fingerprint goes on while gaps are at most the window.

    Needs fingerprint, ts, event_id; repeated event ids of a fingerprint count
    once.  suppressed: whether a rule silences the detection; that closes its
    alert, so what follows is a new one.  A hot fingerprint's detections are
    counted in slices of time, in many tasks.
    """
    return sessionize(detections.dropDuplicates(["fingerprint", "event_id"]), ["fingerprint"], window, ["ts", "event_id"], slice_seconds=slice_seconds, ends=suppressed)


def absorb_alerts(sessions: DataFrame) -> DataFrame:
    """One alert for each session: count, times, peak, hosts, users, tags and at most 50 ids."""
    key = ["fingerprint", "session"]
    # the sample's bound is the alert's own, and taken before ids are gathered; counts cover all
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("event_id"))
    first = sessions.select(*key, "event_id").distinct().withColumn("_n", rank).where(F.col("_n") <= MAX_IDS)
    samples = first.groupBy(*key).agg(F.array_sort(F.collect_list("event_id")).alias("sample_ids"))
    alerts = sessions.groupBy(*key).agg(
        F.count("*").alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max("score").alias("max_score"),
        severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.array_sort(F.collect_set("host")).alias("hosts"),
        F.array_sort(F.collect_set("user")).alias("users"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    return alerts.join(samples, key)


#: Weights of the priority, its saturations, and the bands.
SEVERITY_WEIGHT = {"low": 0.25, "medium": 0.5, "high": 0.8, "critical": 1.0}
PRIORITY_WEIGHTS = {"severity": 0.40, "volume": 0.20, "spread": 0.20, "intel": 0.12, "confidence": 0.08}
VOLUME_SATURATION, SPREAD_SATURATION = 100, 25
BANDS = ((0.82, "P1"), (0.62, "P2"), (0.40, "P3"), (0.20, "P4"))


def priority_score(severity: Column, count: Column, hosts: Column, intel: Column, confidence: Column) -> Column:
    """0 to 1 from severity, log volume, host spread, an intel hit and confidence."""
    sev = F.lit(0.5)
    for name, w in SEVERITY_WEIGHT.items():
        sev = F.when(severity == name, F.lit(w)).otherwise(sev)
    volume = F.when(count <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.log1p((count - 1).cast("double")) / F.log1p(F.lit(float(VOLUME_SATURATION)))))
    spread = F.when(hosts <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (hosts - 1) / F.lit(float(SPREAD_SATURATION - 1))))
    total = sum(PRIORITY_WEIGHTS.values())
    parts = {"severity": sev, "volume": volume, "spread": spread, "intel": intel.cast("double"), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))}
    raw = F.lit(0.0)
    for name, w in PRIORITY_WEIGHTS.items():
        raw = raw + F.lit(w / total) * parts[name]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def priority_band(score: Column) -> Column:
    out = F.lit("P5")
    for floor, name in reversed(BANDS):
        out = F.when(score >= floor, F.lit(name)).otherwise(out)
    return out


def escalations(sessions: DataFrame, at: str = "P2", suppressed: Column | None = None) -> DataFrame:
    """sessions' detections with the running priority, whether the alert is new, whether it just reached the level, and whether it is forwarded.

    Forwarded is what is new or has just reached the level, unless it is
    ``suppressed`` (as in ``triage_sessions``).  Distinct hosts so far are the
    running sum of first occurrences.
    """
    key = ["fingerprint", "session"]
    first = (F.row_number().over(Window.partitionBy(*key, "host").orderBy("ts", "event_id")) == 1).cast("int")
    order = Window.partitionBy(*key).orderBy("ts", "event_id")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sessions.withColumn("_first", F.when(F.col("host").isNotNull(), first).otherwise(0))
    peak = severity_of_rank(F.max(severity_rank(F.col("severity"))).over(running))
    score = priority_score(peak, F.count("*").over(running), F.sum("_first").over(running), F.lit(False), F.max("score").over(running))
    rows = rows.withColumn("priority_score", score).withColumn("priority", priority_band(F.col("priority_score"))).drop("_first")
    before = F.lag("priority").over(order)
    silent = F.coalesce(suppressed, F.lit(False)) if suppressed is not None else F.lit(False)
    rows = rows.withColumn("is_new", before.isNull()).withColumn("escalated", (F.col("priority") <= at) & before.isNotNull() & (before > at) & ~silent)
    return rows.withColumn("forwarded", (F.col("is_new") | F.coalesce("escalated", F.lit(False))) & ~silent)


#: Fields of an alert that suppression rules may name.
RULE_FIELDS = ("detector", "event_type", "host", "user", "process", "severity")
#: Marks a pattern that is matched as a whole, where a prefix has its length.
_WHOLE = -1


def _pattern_keys(rules: DataFrame) -> DataFrame:
    """``rules`` with (size, stem): of a prefix its length and itself, of a whole pattern the mark and itself."""
    is_prefix = F.col("pattern").endswith("*")
    stem = F.when(is_prefix, F.expr("left(pattern, char_length(pattern) - 1)")).otherwise(F.col("pattern"))
    return rules.withColumn("stem", stem).withColumn("size", F.when(is_prefix, F.char_length(stem)).otherwise(_WHOLE))


def _value_keys(values: DataFrame, lengths: DataFrame) -> DataFrame:
    """``values`` (field, value, ...) once for the whole value and once for each prefix of a length that occurs in the rules of its field."""
    sized = values.join(F.broadcast(lengths), "field")
    sizes = F.filter("sizes", lambda n: (n == _WHOLE) | (n <= F.char_length("value")))
    exploded = sized.withColumn("size", F.explode(sizes)).drop("sizes")
    return exploded.withColumn("stem", F.when(F.col("size") == _WHOLE, F.col("value")).otherwise(F.substring(F.col("value"), F.lit(1), F.col("size"))))


def _newest_of_equals(anchors: DataFrame) -> DataFrame:
    """Of rules with one pattern only, those that a newer one with the same pattern and severity does not outlive."""
    newer = Window.partitionBy("field", "size", "stem", "max_severity", "need").orderBy(F.desc("created_at"), F.desc("rule_id")).rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce("expires_at", F.lit(float("inf")))
    return anchors.withColumn("_outlived", F.max(until).over(newer)).where((F.col("need") > 1) | F.col("_outlived").isNull() | (until > F.col("_outlived"))).drop("_outlived")


def apply_suppressions(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts with the rule that suppresses them, the newest of those that match, or null.

    rules: (rule_id, field, pattern, max_severity, created_at, expires_at,
    enabled), one row for each field of a rule; all fields of a rule must match.
    A pattern matches exactly, or by prefix if it ends with ``*``; a rule without
    fields matches nothing.

    Patterns are an index: a value is looked up as a whole and by its prefixes
    of the lengths that occur, all of them equi joins.  A rule is looked up by
    the one of its fields that fewest alerts match, and its other fields are
    compared for what that finds; so neither alerts nor rules meet in pairs.
    """
    live = _pattern_keys(rules.where("enabled and field is not null and pattern is not null"))
    # at most a row for each field, with the lengths of its patterns
    lengths = live.groupBy("field").agg(F.collect_set("size").alias("sizes"))
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in RULE_FIELDS)))
    counts = alerts.select(values.alias("f")).select("f.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    hits = _value_keys(counts, lengths).groupBy("field", "size", "stem").agg(F.sum("n").alias("n"))
    found = live.join(hits, ["field", "size", "stem"], "left")
    fields = F.collect_list(F.struct("n", "field", "size", "stem"))
    rule = found.groupBy("rule_id").agg(fields.alias("fields"), F.max("created_at").alias("created_at"), F.min("expires_at").alias("expires_at"), F.min("max_severity").alias("max_severity"))
    # a rule one of whose fields no alert matches goes
    rule = rule.where(F.forall("fields", lambda f: f["n"].isNotNull())).withColumn("need", F.size("fields")).withColumn("a", F.array_min("fields"))
    anchors = _newest_of_equals(rule.select("rule_id", "created_at", "expires_at", "max_severity", "need", "fields", "a.field", "a.size", "a.stem"))
    own = F.struct(*(F.col(n).cast("string").alias(n) for n in RULE_FIELDS)).alias("own")
    keys = _value_keys(alerts.select("event_id", "ts", "severity", own, values.alias("f")).select("event_id", "ts", "severity", "own", "f.*").where("value is not null"), lengths)
    near = keys.join(anchors.withColumnRenamed("max_severity", "_ceiling"), ["field", "size", "stem"])

    def holds(f: Column) -> Column:
        value = F.lit(None).cast("string")
        for n in RULE_FIELDS:
            value = F.when(f["field"] == n, F.col("own")[n]).otherwise(value)
        return F.coalesce(F.when(f["size"] == _WHOLE, value == f["stem"]).otherwise(value.startswith(f["stem"])), F.lit(False))

    in_time = (F.col("expires_at").isNull() | (F.col("ts") < F.col("expires_at"))) & (F.col("_ceiling").isNull() | (severity_rank(F.col("severity")) <= severity_rank(F.col("_ceiling"))))
    best = near.where(in_time & F.forall("fields", holds)).groupBy("event_id").agg(F.max(F.struct("created_at", "rule_id"))["rule_id"].alias("suppressed_by"))
    return alerts.join(best, "event_id", "left")


#: Phases by technique, by a tag's substring in this order, and by event type.
TECHNIQUE_PHASE = {
    "T1027": "weaponization", "T1055": "exploitation", "T1059": "exploitation", "T1003": "actions_on_objectives",
    "T1547": "installation", "T1078": "exploitation", "T1071": "command_and_control", "T1486": "actions_on_objectives",
}
TAG_HINTS = (
    ("reconnaissance", "reconnaissance"), ("recon", "reconnaissance"), ("scanning", "reconnaissance"), ("weaponization", "weaponization"), ("phish", "delivery"), ("delivery", "delivery"),
    ("execution", "exploitation"), ("exploit", "exploitation"), ("persistence", "installation"), ("install", "installation"), ("c2", "command_and_control"),
    ("command_and_control", "command_and_control"), ("beacon", "command_and_control"), ("exfiltration", "actions_on_objectives"), ("impact", "actions_on_objectives"), ("ransomware", "actions_on_objectives"),
)
TYPE_PHASE = {"auth": "exploitation", "network": "command_and_control", "process": "exploitation"}


def kill_chain_phase() -> Column:
    """By the first technique tag that has a phase, else by tag hints in order, else by type."""
    tags = F.transform("tags", F.lower)
    technique = F.transform(F.filter(tags, lambda t: t.startswith("mitre:")), lambda t: F.upper(F.substring_index(F.substring(t, 7, 64), ".", 1)))
    known = F.create_map(*(F.lit(x) for kv in TECHNIQUE_PHASE.items() for x in kv))
    by_technique = F.get(F.filter(F.transform(technique, lambda t: F.element_at(known, t)), lambda p: p.isNotNull()), F.lit(0))
    by_hint = F.coalesce(*(F.when(F.array_join(tags, "\n").contains(needle), F.lit(phase)) for needle, phase in TAG_HINTS))
    by_type = F.when((F.col("event_type") == "file") & F.lower("action").isin("write", "create"), F.lit("installation")).otherwise(F.lit("unknown"))
    for kind, phase in TYPE_PHASE.items():
        by_type = F.when(F.col("event_type") == kind, F.lit(phase)).otherwise(by_type)
    return F.coalesce(by_technique, by_hint, by_type)


def incident_timeline(detections: DataFrame, key: str = "incident_id") -> DataFrame:
    """Each detection, and an escalation row where the severity differs from the one before."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    rows = detections.withColumn("before", F.lag("severity").over(order))
    seen = rows.select(key, "ts", "event_id", F.lit("detection").alias("kind"), F.concat_ws(" ", F.upper("severity"), "detector").alias("title"))
    jump = rows.where("severity <> before").select(key, "ts", "event_id", F.lit("escalation").alias("kind"), F.concat(F.lit("severity "), "before", F.lit(" -> "), "severity").alias("title"))
    return seen.unionByName(jump)


def kill_chain_steps(detections: DataFrame, key: str = "incident_id") -> DataFrame:
    """Each incident's steps (ts, event_id, phase) in order."""
    step = F.struct("ts", "event_id", kill_chain_phase().alias("phase"))
    return detections.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def group_scores(detections: DataFrame, key: str = "group_id", boost: float = 0.15) -> DataFrame:
    """(key, score, severity, detections): s := min(1, max(s, d) + boost (n - 1)) over a group's detections in order.

    The fold ends at 1 as soon as (n - 1) boosts reach it, so only a group's
    first 1 / boost + 1 detections can matter; those are kept before anything is collected.
    """
    need = int(1 / boost) + 2
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    head = detections.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= need)
    series = head.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "score"))).alias("s"))
    fold = F.aggregate("s", F.lit(0.0), lambda acc, x: F.least(F.lit(1.0), F.greatest(acc, x["score"]) + boost * (x["_n"] - 1)))
    counts = detections.groupBy(key).agg(F.count("*").alias("detections"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return series.select(key, fold.alias("score")).join(counts, key).withColumn("severity", severity_from_score(F.col("score")))


def promote_incidents(detections: DataFrame, key: str = "group_id", min_score: float = 0.55, min_severity: str = "medium", min_detections: int = 3) -> DataFrame:
    """Groups that are hot enough or large enough, with what they affect and a title from the top detection."""
    scored = group_scores(detections, key)
    hot = (F.col("score") >= min_score) & (severity_rank(F.col("severity")) >= SEVERITIES.index(min_severity))
    about = detections.groupBy(key).agg(
        F.array_sort(F.collect_set("host")).alias("hosts"), F.array_sort(F.collect_set("user")).alias("users"),
        F.max_by(F.struct("severity", "detector"), F.struct("score", (-F.col("event_id")).alias("e"))).alias("top"),
    )
    n = F.size("hosts")
    where = F.when(n == 0, "").when(n == 1, F.concat(F.lit(" on "), F.get("hosts", F.lit(0)))).otherwise(F.concat(F.lit(" on "), F.get("hosts", F.lit(0)), F.lit(" (+"), (n - 1).cast("string"), F.lit(" hosts)")))
    title = F.concat(F.initcap("top.severity"), F.lit(" "), F.col("top.detector"), F.lit(" activity"), where)
    return scored.where(hot | (F.col("detections") >= min_detections)).join(about, key).withColumn("title", title).drop("top")


def verify_custody(entries: DataFrame) -> DataFrame:
    """(case_id, valid): each entry's hash follows from its fields and the hash before it."""
    order = Window.partitionBy("case_id").orderBy("seq")
    before = F.coalesce(F.lag("entry_hash").over(order), F.lit(""))
    good = (F.col("entry_hash") == custody_hash(before)) & (F.col("prev_hash") == before)
    return entries.withColumn("good", good).groupBy("case_id").agg(F.bool_and("good").alias("valid"))


def custody_hash(before: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "action", "actor", F.format_string("%.6f", "ts"), "detail", before), 256)


def append_custody(entries: DataFrame) -> DataFrame:
    """Seq and hashes for a case's entries (case_id, ts, action, actor, detail) in order of time.

    A hash needs the one before, so each case's log is folded in order, with the last hash carried.
    """
    told = F.concat_ws("|", "action", "actor", F.format_string("%.6f", "ts"), "detail")

    def fold():
        state = {"seq": 0, "hash": ""}

        def step(rows: dict[str, list]) -> dict[str, list]:
            first, before, after = state["seq"] + 1, [], []
            for seq, text in enumerate(rows["told"], first):
                before.append(state["hash"])
                state.update(seq=seq, hash=hashlib.sha256(f"{seq}|{text}|{state['hash']}".encode()).hexdigest())
                after.append(state["hash"])
            seqs = range(first, first + len(after))
            return {"case_id": rows["case_id"], "seq": seqs} | {c: rows[c] for c in ("ts", "action", "actor", "detail")} | {"prev_hash": before, "entry_hash": after}

        return step

    schema = "case_id string, seq int, ts double, action string, actor string, detail string, prev_hash string, entry_hash string"
    rows = entries.select("case_id", F.col("ts").cast("double").alias("ts"), "action", "actor", "detail", told.alias("told"))
    return ordered_fold(rows, ["case_id"], ["ts", "action", "actor", "detail"], schema, fold)


#: Minutes to the first response and to resolution by priority; the rest of a window that is at risk.
RESPONSE_MINUTES = {"p1": 15, "p2": 60, "p3": 240, "p4": 1440}
RESOLVE_MINUTES = {"p1": 240, "p2": 1440, "p3": 4320, "p4": 10080}
AT_RISK = 0.8


def sla_status(cases: DataFrame, custody: DataFrame, now: float) -> DataFrame:
    """Response and resolution of each case (case_id, priority, created_at, closed_at): met, breached, at_risk or on_track."""
    first = custody.where(F.col("action").isin("assigned", "status_changed")).groupBy("case_id").agg(F.min_by("ts", "seq").alias("responded_at"))

    def window(minutes: dict[str, int], other: int) -> Column:
        out = F.lit(other)
        for p, m in minutes.items():
            out = F.when(F.col("priority") == p, F.lit(m)).otherwise(out)
        return out * 60.0

    def status(done: Column, size: Column) -> Column:
        elapsed = F.lit(float(now)) - F.col("created_at")
        live = F.when(elapsed >= size, "breached").when(elapsed >= size * AT_RISK, "at_risk").otherwise("on_track")
        return F.when(done.isNull(), live).when(done <= F.col("created_at") + size, "met").otherwise("breached")

    joined = cases.join(first, "case_id", "left")
    return joined.select(
        "case_id", "priority", status(F.col("responded_at"), window(RESPONSE_MINUTES, 240)).alias("response"), status(F.col("closed_at"), window(RESOLVE_MINUTES, 4320)).alias("resolution")
    )

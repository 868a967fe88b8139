"""Suppression rules by an index against every rule with every alert."""

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.functions.severity import SEVERITIES
from sentrylake.operators import triage

ALERT = "event_id long, ts double, severity string, detector string, event_type string, host string, user string, process string"
RULE = "rule_id string, field string, pattern string, max_severity string, created_at long, expires_at double, enabled boolean"


def matches(value, pattern):
    return value is not None and (value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern)


def plain(alerts, rules):
    out, by = {}, {}
    for r in rules:
        if r[6] and r[1] is not None:
            by.setdefault(r[0], []).append(r)
    names = [c.split()[0] for c in ALERT.split(", ")]
    for a in alerts:
        row, best = dict(zip(names, a)), None
        for rule, fields in by.items():
            _, _, _, ceiling, created, expires, _ = fields[0]
            in_time = (expires is None or row["ts"] < expires) and (ceiling is None or SEVERITIES.index(row["severity"]) <= SEVERITIES.index(ceiling))
            if in_time and all(matches(row.get(f[1]), f[2]) for f in fields) and (best is None or (created, rule) > best):
                best = (created, rule)
        out[row["event_id"]] = best and best[1]
    return out


def made(seed, n_alerts=400, n_rules=120):
    draw = random.Random(seed)
    alerts = [
        (i, float(draw.randrange(1_000)), draw.choice(SEVERITIES), draw.choice(["rule", "ioc"]), draw.choice(["process", "file"]), draw.choice(["web-1", "web-2", "db-1", None, ""]), draw.choice(["root", "bob", "bo*"]), draw.choice(["bash", "bashful", "sh", "séance"]))
        for i in range(n_alerts)
    ]
    patterns = {"detector": ["rule", "ioc", "r*"], "event_type": ["process", "*"], "host": ["web-1", "web*", "db-1", "nohost"], "user": ["bob", "b*", "bo*", "root"], "process": ["bash", "bash*", "s*", "sé*"], "severity": ["high", "low"], "unknown": ["x"]}
    rules = []
    for r in range(n_rules):
        common = (draw.choice([None, None, "medium", "high"]), draw.randrange(30), draw.choice([None, None, 400.0]), draw.random() > 0.1)
        rules += [(f"r{r:03d}", f, draw.choice(patterns[f]), *common) for f in draw.sample(sorted(patterns), draw.choice([1, 1, 2, 3]))]
    return alerts, rules + [("empty", None, None, None, 99, None, True)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_all_pairs(spark, seed):
    alerts, rules = made(seed)
    out = triage.apply_suppressions(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(rules, RULE)).collect()
    assert {r["event_id"]: r["suppressed_by"] for r in out} == plain(alerts, rules) and len(out) == len(alerts)


def test_many_rules_and_alerts_do_not_meet_in_pairs(spark):
    """100,000 rules on hosts and a hot detector: what is found is what matches by host."""
    alerts = spark.range(200_000).select(
        F.col("id").alias("event_id"), (F.col("id") * 1.0).alias("ts"), F.lit("high").alias("severity"), F.lit("rule").alias("detector"), F.lit("process").alias("event_type"),
        F.concat(F.lit("h"), F.col("id") % 150_000).alias("host"), F.lit("u").alias("user"), F.lit("bash").alias("process"),
    )
    both = F.explode(F.array(F.struct(F.lit("detector").alias("field"), F.lit("ru*").alias("pattern")), F.struct(F.lit("host").alias("field"), F.concat(F.lit("h"), F.col("id")).alias("pattern"))))
    rules = spark.range(100_000).select(F.concat(F.lit("r"), F.col("id")).alias("rule_id"), both.alias("b"), F.col("id").alias("created_at")).select(
        "rule_id", "b.*", F.lit(None).cast("string").alias("max_severity"), "created_at", F.lit(None).cast("double").alias("expires_at"), F.lit(True).alias("enabled")
    )
    out = triage.apply_suppressions(alerts, rules)
    hit = out.where("suppressed_by is not null")
    assert out.count() == 200_000 and hit.count() == 100_000 + 50_000
    assert hit.where(F.col("suppressed_by") != F.concat(F.lit("r"), F.substring("host", 2, 9))).isEmpty()


def test_many_rules_with_one_pattern(spark):
    alerts, _ = made(4)
    rules = [(f"r{i:05d}", "detector", "rule", None, i, 5_000.0 - i, True) for i in range(3_000)] + [("new", "detector", "rule", None, 9_999, 500.0, True)]
    out = triage.apply_suppressions(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(rules, RULE)).collect()
    assert {r["event_id"]: r["suppressed_by"] for r in out} == plain(alerts, rules)


def test_no_rules(spark):
    alerts, _ = made(5)
    out = triage.apply_suppressions(spark.createDataFrame(alerts, ALERT), spark.createDataFrame([], RULE)).collect()
    assert len(out) == len(alerts) and not any(r["suppressed_by"] for r in out)

"""Playbooks, incident lookups, lists and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import run_hunts
from ..operators import response, store, triage
from ..sources.standins import DET_SQL, SEC_SQL, detections, security_events, table
from .model_queries import drift_report, model_lifecycle
from .registry import ORACLE_SQL, query
from .triage_queries import _GROUP_SQL, host_days, sessions
from .triage_queries import _ALERT_SQL

PLAYBOOKS = (
    {"playbook_id": "isolate", "min_severity": "high", "tags_required": ["c2", "impact"], "steps": ["isolate", "notify"]},
    {"playbook_id": "lock", "conditions": [{"field": "event_type", "op": "==", "value": "auth"}, {"field": "score", "op": ">", "value": 0.6}, {"field": "status", "op": "in", "value": ["failure"]}], "steps": ["lock"]},
    {"playbook_id": "path", "conditions": [{"field": "file_path", "op": "contains", "value": "locked"}, {"field": "tags", "op": "contains", "value": "impact"}], "steps": ["a", "b", "c"]},
    {"playbook_id": "off", "enabled": False, "steps": ["x"]},
)


@query(
    "j16_match_playbooks",
    f"""WITH {DET_SQL}, m AS (SELECT event_id, 'isolate' AS playbook_id, ['isolate', 'notify'] AS s FROM det WHERE severity IN ('high', 'critical') AND event_type IN ('network', 'file')
    UNION ALL SELECT event_id, 'lock', ['lock'] FROM det WHERE event_type = 'auth' AND score > 0.6 AND status = 'failure' UNION ALL SELECT event_id, 'path', ['a', 'b', 'c'] FROM det WHERE file_path LIKE '%locked%' AND event_type = 'file')
    SELECT event_id, playbook_id, generate_subscripts(s, 1) - 1 AS step, unnest(s) AS action FROM m""",
)
def match_playbooks(spark, sf_dir):
    return response.match_playbooks(detections(spark, sf_dir), PLAYBOOKS)


@query("f21_playbook_conditions", f"WITH {DET_SQL} SELECT event_id FROM det WHERE event_type = 'auth' AND score > 0.6 AND status = 'failure'")
def playbook_conditions(spark, sf_dir):
    return detections(spark, sf_dir).where(response.playbook_applies(PLAYBOOKS[1])).select("event_id")


@query(
    "j17_incident_detections",
    f"""WITH {_GROUP_SQL} SELECT incident_id, event_id, detector, severity FROM inc WHERE incident_id IN (SELECT group_id FROM grp WHERE score >= 0.55 OR detections >= 3)""",
)
def incident_detections(spark, sf_dir):
    rows = host_days(spark, sf_dir, "group_id")
    ids = rows.groupBy("group_id").agg(F.collect_set("event_id").alias("detection_ids"))
    incidents = triage.promote_incidents(rows).join(ids, "group_id").select(F.col("group_id").alias("incident_id"), "detection_ids")
    return response.incident_detections(incidents, detections(spark, sf_dir)).select("incident_id", "event_id", "detector", "severity")


@query("j11_detections_for_event", f"WITH {DET_SQL} SELECT event_id, host, score FROM sec JOIN (SELECT event_id, score FROM det WHERE severity = 'critical') USING (event_id)")
def detections_for_event(spark, sf_dir):
    return security_events(spark, sf_dir).join(detections(spark, sf_dir).where("severity = 'critical'").select("event_id", "score"), "event_id").select("event_id", "host", "score")


@query(
    "f23_incident_list",
    f"WITH {_GROUP_SQL} SELECT group_id, round(score, 9) AS score FROM grp WHERE (score >= 0.55 OR detections >= 3) AND list_contains(hosts, 'h7') ORDER BY last_seen DESC, grp.score DESC LIMIT 20",
)
def incident_list(spark, sf_dir):
    found = triage.promote_incidents(host_days(spark, sf_dir, "group_id"))
    return store.newest(found, 20, F.array_contains("hosts", "h7"), order=(F.desc("last_seen"), F.desc("score"))).select("group_id", F.round("score", 9).alias("score"))


@query(
    "f24_triage_list",
    f"WITH {_ALERT_SQL} SELECT fingerprint, first_seen, max_score FROM alert WHERE severity = 'critical' ORDER BY max_score DESC, last_seen DESC, fingerprint LIMIT 50",
)
def triage_list(spark, sf_dir):
    a = triage.absorb_alerts(sessions(spark, sf_dir))
    return store.newest(a, 50, F.col("severity") == "critical", order=(F.desc("max_score"), F.desc("last_seen"), "fingerprint")).select("fingerprint", "first_seen", "max_score")


_CASES = "cases AS (SELECT o_orderkey AS case_id, o_orderstatus AS status, left(o_orderpriority, 1) AS priority, o_custkey % 10 AS assignee, epoch(o_orderdate) AS updated FROM orders)"


def cases(spark, sf_dir):
    updated = F.unix_micros(F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone())) / F.lit(1e6)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.left("o_orderpriority", F.lit(1)).alias("priority"), (F.col("o_custkey") % 10).alias("assignee"), updated.alias("updated"))


@query("f25_case_list", f"WITH {_CASES} SELECT case_id, priority, updated FROM cases WHERE status = 'O' AND assignee = 3 ORDER BY priority, updated DESC, case_id LIMIT 25")
def case_list(spark, sf_dir):
    return store.newest(cases(spark, sf_dir), 25, (F.col("status") == "O") & (F.col("assignee") == 3), order=("priority", F.desc("updated"), "case_id")).select("case_id", "priority", "updated")


@query("f26_audit_list", f"WITH {_CASES} SELECT case_id, updated FROM cases WHERE status = 'F' AND priority = '1' ORDER BY updated DESC, case_id DESC LIMIT 30")
def audit_list(spark, sf_dir):
    return store.newest(cases(spark, sf_dir), 30, (F.col("status") == "F") & (F.col("priority") == "1"), order=(F.desc("updated"), F.desc("case_id"))).select("case_id", "updated")


@query("a19_case_stats", f"WITH {_CASES} SELECT status, priority, count(*) AS count FROM cases GROUP BY ALL")
def case_stats(spark, sf_dir):
    return store.counts_by(cases(spark, sf_dir), "status", "priority")


@query("a20_audit_stats", f"WITH {_CASES} SELECT 'status' AS dimension, status AS value, count(*) AS count FROM cases GROUP BY 2 UNION ALL SELECT 'assignee', CAST(assignee AS VARCHAR), count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM cases")
def audit_stats(spark, sf_dir):
    return store.counts_by_each(cases(spark, sf_dir), "status", "assignee")


@query(
    "a32_incident_section",
    f"""WITH {_GROUP_SQL}, i AS (SELECT CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity, hosts[1] AS host FROM grp WHERE score >= 0.55 OR detections >= 3)
    SELECT 'severity' AS dimension, severity AS value, count(*) AS count FROM i GROUP BY 2 UNION ALL SELECT 'host', host, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM i""",
)
def incident_section(spark, sf_dir):
    found = triage.promote_incidents(host_days(spark, sf_dir, "group_id")).withColumn("host", F.get("hosts", F.lit(0)))
    return store.counts_by_each(found, "severity", "host")


@query("a34_hunt_section", f"WITH {SEC_SQL} SELECT 2 AS hunts, 2 AS runs, CAST(count(*) FILTER (file_path LIKE '%.locked') + count(*) FILTER (action = 'write') AS BIGINT) AS hits FROM sec")
def hunt_section(spark, sf_dir):
    return response.hunt_section(run_hunts(security_events(spark, sf_dir), {"locked": "file_path like '%.locked'", "writes": "action = 'write'"}))


@query(
    "a35_registry_summary",
    f"WITH l AS ({ORACLE_SQL['w19_model_lifecycle']}) SELECT model_id, count(*) AS versions, max(version) FILTER (status = 'production') AS production, arg_max(status, version) AS latest_status FROM l GROUP BY 1",
)
def registry_summary(spark, sf_dir):
    return response.registry_summary(model_lifecycle(spark, sf_dir))


@query(
    "w18_retrain_decision",
    f"WITH d AS ({ORACLE_SQL['w17_drift_report']}) SELECT cusum, composite, CASE WHEN triggered AND composite >= 0.3 AND current_size >= 100 THEN 'drift_detected' ELSE 'none' END AS reason FROM d",
)
def retrain_decision(spark, sf_dir):
    return response.retrain_decision(drift_report(spark, sf_dir), 10.0, 86400.0, "medium").select("cusum", "composite", "reason")


@query(
    "a37_edge_set_metrics",
    """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_suppkey AS s, l_partkey AS p FROM lineitem), x AS (SELECT s % 3 = 0 AND p % 2 = 0 AS e, (s <= 50 AND p <= 500) OR (s = 60 AND p % 5 = 0) AS t FROM e)
    SELECT count(*) FILTER (e AND t) AS tp, count(*) FILTER (e AND NOT t) AS fp, count(*) FILTER (NOT e AND t) AS fn, count(*) FILTER (NOT e AND NOT t) AS tn FROM x""",
)
def edge_set_metrics(spark, sf_dir):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    name = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(s, p, name("s", s).alias("src"), name("p", p).alias("dst"))
    truth = rows.where(s <= 50).select(F.col("src").alias("node")).unionByName(rows.where(p <= 500).select(F.col("dst").alias("node")))
    return response.edge_set_metrics(rows.where((s % 3 == 0) & (p % 2 == 0)), rows, truth, rows.where((s == 60) & (p % 5 == 0)))


@query("a41_report_stats", f"WITH {_CASES} SELECT status, count(*) AS count FROM cases GROUP BY 1")
def report_stats(spark, sf_dir):
    return store.counts_by(cases(spark, sf_dir), "status")

"""Alerts, incidents and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import triage
from ..sources.standins import DET_SQL, detections
from .registry import query

_FP = """substr(sha1(CASE event_type WHEN 'process' THEN 'detector=' || detector || '|process=' || process || '|type=process'
    WHEN 'network' THEN 'detector=' || detector || '|dst_ip=' || dst_ip || '|dst_port=' || dst_port || '|protocol=' || protocol || '|type=network'
    WHEN 'file' THEN 'detector=' || detector || '|file_path=' || file_path || '|action=' || action || '|type=file'
    WHEN 'auth' THEN 'detector=' || detector || '|user=' || "user" || '|status=' || status || '|type=auth'
    ELSE 'detector=' || detector || '|process=' || process || '|action=' || action || '|type=syscall' END), 1, 16)"""
#: A day's gap, as the view has few events an hour.
GAP = 86400.0
SESSION_SQL = (
    DET_SQL
    + f""", fp AS (SELECT *, {_FP} AS fingerprint FROM det),
    gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts, event_id) <= {GAP} THEN 0 ELSE 1 END AS is_new FROM fp),
    ses AS (SELECT *, sum(is_new) OVER (PARTITION BY fingerprint ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps)"""
)


def sessions(spark, sf_dir):
    return triage.triage_sessions(detections(spark, sf_dir).withColumn("fingerprint", triage.alert_fingerprint()), GAP)


@query("p16_alert_fingerprint", f"WITH {DET_SQL} SELECT event_id, {_FP} AS fingerprint FROM det")
def alert_fingerprint(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", triage.alert_fingerprint().alias("fingerprint"))


@query(
    "p17_alert_title",
    f"""WITH {DET_SQL} SELECT event_id, upper(severity[1]) || severity[2:] || ': ' || detector || ' ' || event_type || ' activity ' || CASE event_type WHEN 'network' THEN 'dst_ip=' || dst_ip
      WHEN 'file' THEN 'file_path=' || file_path WHEN 'auth' THEN 'user=' || "user" ELSE 'process=' || process END AS title FROM det""",
)
def alert_title(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", triage.alert_title().alias("title"))


@query("w07_triage_sessions", f"WITH {SESSION_SQL} SELECT event_id, fingerprint, CAST(session AS BIGINT) AS session FROM ses")
def triage_sessions(spark, sf_dir):
    return sessions(spark, sf_dir).select("event_id", "fingerprint", "session")


_ALERT_SQL = (
    SESSION_SQL
    + """, alert AS (SELECT fingerprint, session, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, max(score) AS max_score,
    ['low', 'medium', 'high', 'critical'][max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END)] AS severity,
    count(DISTINCT host) AS hosts, list_sort(list(DISTINCT event_id))[1:50] AS ids FROM ses GROUP BY ALL)"""
)


@query(
    "a13_absorb_alert",
    f"WITH {_ALERT_SQL} SELECT fingerprint, CAST(session AS BIGINT) AS session, count, first_seen, last_seen, max_score, severity, hosts, array_to_string(ids, ',') AS sample_ids FROM alert",
)
def absorb_alert(spark, sf_dir):
    a = triage.absorb_alerts(sessions(spark, sf_dir))
    ids = F.array_join(F.transform("sample_ids", lambda x: x.cast("string")), ",").alias("sample_ids")
    return a.select("fingerprint", "session", "count", "first_seen", "last_seen", "max_score", "severity", F.size("hosts").alias("hosts"), ids)


def _priority_sql(severity, count, hosts, intel, score):
    return f"""0.40 * CASE {severity} WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.8 ELSE 1.0 END
      + 0.20 * CASE WHEN {count} <= 1 THEN 0 ELSE least(1.0, ln(1 + {count} - 1) / ln(101)) END + 0.20 * CASE WHEN {hosts} <= 1 THEN 0 ELSE least(1.0, ({hosts} - 1) / 24.0::DOUBLE) END
      + 0.12 * {intel} + 0.08 * greatest(0, least(1, {score}))"""


_BAND = "CASE WHEN {0} >= 0.82 THEN 'P1' WHEN {0} >= 0.62 THEN 'P2' WHEN {0} >= 0.40 THEN 'P3' WHEN {0} >= 0.20 THEN 'P4' ELSE 'P5' END"


@query(
    "a14_priority_score",
    f"""WITH {_ALERT_SQL}, p AS (SELECT *, {_priority_sql('severity', 'count', 'hosts', 'CASE WHEN fingerprint < \'8\' THEN 1 ELSE 0 END', 'max_score')} AS s FROM alert)
    SELECT fingerprint, CAST(session AS BIGINT) AS session, round(s, 6) AS priority_score, {_BAND.format('round(s, 9)')} AS priority FROM p""",
)
def priority_score(spark, sf_dir):
    a = triage.absorb_alerts(sessions(spark, sf_dir))
    s = triage.priority_score(F.col("severity"), F.col("count"), F.size("hosts"), F.col("fingerprint") < "8", F.col("max_score"))
    return a.select("fingerprint", "session", F.round(s, 6).alias("priority_score"), triage.priority_band(F.round(s, 9)).alias("priority"))


@query(
    "a15_triage_stats",
    f"""WITH {_ALERT_SQL} SELECT count(*) AS alerts, CAST(sum(count) AS BIGINT) AS detections, round(1 - count(*) / sum(count), 9) AS dedup_ratio, count(*) FILTER (severity = 'critical') AS critical FROM alert""",
)
def triage_stats(spark, sf_dir):
    a = triage.absorb_alerts(sessions(spark, sf_dir))
    return a.agg(F.count("*").alias("alerts"), F.sum("count").alias("detections"), F.round(1 - F.count("*") / F.sum("count"), 9).alias("dedup_ratio"), F.count_if(F.col("severity") == "critical").alias("critical"))


_RUNNING = "(PARTITION BY fingerprint, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    "w08_triage_escalations",
    f"""WITH {SESSION_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, session, host ORDER BY ts, event_id) AS hn FROM ses),
    r AS (SELECT *, ['low', 'medium', 'high', 'critical'][max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) OVER {_RUNNING}] AS peak, count(*) OVER {_RUNNING} AS n,
      sum(CASE WHEN hn = 1 THEN 1 ELSE 0 END) OVER {_RUNNING} AS h, max(score) OVER {_RUNNING} AS top FROM f),
    p AS (SELECT *, {_priority_sql('peak', 'n', 'h', '0', 'top')} AS s FROM r), b AS (SELECT *, {_BAND.format('s')} AS priority FROM p),
    l AS (SELECT *, lag(priority) OVER (PARTITION BY fingerprint, session ORDER BY ts, event_id) AS was FROM b)
    SELECT event_id, priority, was IS NULL AS is_new, coalesce(priority <= 'P2' AND was > 'P2', false) AS escalated FROM l""",
)
def triage_escalations(spark, sf_dir):
    return triage.escalations(sessions(spark, sf_dir)).select("event_id", "priority", "is_new", F.coalesce("escalated", F.lit(False)).alias("escalated"))


#: Suppression rules as a view over nations: each suppresses one host or process prefix.
_RULES = """(SELECT 'r' || n_nationkey AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'host' ELSE 'process' END AS field, CASE WHEN n_nationkey % 2 = 0 THEN 'h' || n_nationkey WHEN n_nationkey % 3 = 0 THEN 'p*' ELSE 'p' || (n_nationkey % 10) END AS pattern,
    CASE WHEN n_nationkey % 5 = 0 THEN 'medium' END AS max_severity, n_nationkey AS created_at, CASE WHEN n_nationkey % 4 = 0 THEN 1705320000.0 END AS expires_at, n_nationkey % 7 <> 0 AS enabled FROM nation)"""


def suppression_rules(spark, sf_dir):
    k = F.col("n_nationkey")
    text = k.cast("string")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.concat(F.lit("r"), text).alias("rule_id"),
        F.when(k % 2 == 0, "host").otherwise("process").alias("field"),
        F.when(k % 2 == 0, F.concat(F.lit("h"), text)).when(k % 3 == 0, F.lit("p*")).otherwise(F.concat(F.lit("p"), (k % 10).cast("string"))).alias("pattern"),
        F.when(k % 5 == 0, "medium").alias("max_severity"),
        k.alias("created_at"),
        F.when(k % 4 == 0, 1705320000.0).alias("expires_at"),
        (k % 7 != 0).alias("enabled"),
    )


@query(
    "j15_apply_suppressions",
    f"""WITH {DET_SQL}, rules AS {_RULES}, m AS (SELECT event_id, max_by(rule_id, created_at) AS suppressed_by FROM det JOIN rules ON enabled AND (expires_at IS NULL OR ts < expires_at)
      AND (max_severity IS NULL OR severity IN ('low', 'medium')) AND (CASE WHEN field = 'host' THEN host ELSE process END = pattern OR (pattern LIKE '%*' AND field = 'process' AND starts_with(process, 'p'))) GROUP BY 1)
    SELECT event_id, suppressed_by FROM det LEFT JOIN m USING (event_id)""",
)
def apply_suppressions(spark, sf_dir):
    return triage.apply_suppressions(detections(spark, sf_dir), suppression_rules(spark, sf_dir)).select("event_id", "suppressed_by")


_FORWARDED_SQL = f"""WITH {DET_SQL}, rules AS {_RULES}, m AS (SELECT DISTINCT event_id FROM det JOIN rules ON enabled AND (expires_at IS NULL OR ts < expires_at)
      AND (max_severity IS NULL OR severity IN ('low', 'medium')) AND (CASE WHEN field = 'host' THEN host ELSE process END = pattern OR (pattern LIKE '%*' AND field = 'process' AND starts_with(process, 'p')))),
    fp AS (SELECT det.*, {_FP} AS fingerprint, m.event_id IS NOT NULL AS sup FROM det LEFT JOIN m USING (event_id)),
    gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= {GAP} AND NOT lag(sup) OVER w THEN 0 ELSE 1 END AS is_new FROM fp WINDOW w AS (PARTITION BY fingerprint ORDER BY ts, event_id)),
    ses AS (SELECT *, sum(is_new) OVER (PARTITION BY fingerprint ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
    f AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, session, host ORDER BY ts, event_id) AS hn FROM ses),
    r AS (SELECT *, ['low', 'medium', 'high', 'critical'][max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) OVER {_RUNNING}] AS peak, count(*) OVER {_RUNNING} AS n,
      sum(CASE WHEN hn = 1 THEN 1 ELSE 0 END) OVER {_RUNNING} AS h, max(score) OVER {_RUNNING} AS top FROM f),
    p AS (SELECT *, {_priority_sql('peak', 'n', 'h', '0', 'top')} AS s FROM r), b AS (SELECT *, {_BAND.format('s')} AS priority FROM p),
    l AS (SELECT *, lag(priority) OVER (PARTITION BY fingerprint, session ORDER BY ts, event_id) AS was FROM b)
    SELECT event_id, CAST(session AS BIGINT) AS session, sup AS suppressed, NOT sup AND (was IS NULL OR (priority <= 'P2' AND was > 'P2')) AS forwarded FROM l"""


@query("w08_forwarded_alerts", _FORWARDED_SQL)
def forwarded_alerts(spark, sf_dir):
    det = detections(spark, sf_dir)
    marked = triage.apply_suppressions(det, suppression_rules(spark, sf_dir)).withColumn("fingerprint", triage.alert_fingerprint())
    suppressed = F.col("suppressed_by").isNotNull()
    ses = triage.triage_sessions(marked, GAP, suppressed=suppressed)
    return triage.escalations(ses, suppressed=suppressed).select("event_id", "session", suppressed.alias("suppressed"), "forwarded")


@query(
    "a16_suppression_stats",
    f"WITH rules AS {_RULES} SELECT count(*) FILTER (enabled AND (expires_at IS NULL OR expires_at > 1706000000)) AS active, count(*) FILTER (enabled AND expires_at <= 1706000000) AS expired, count(*) FILTER (NOT enabled) AS disabled FROM rules",
)
def suppression_stats(spark, sf_dir):
    live = F.col("expires_at").isNull() | (F.col("expires_at") > 1706000000)
    return suppression_rules(spark, sf_dir).agg(F.count_if(F.col("enabled") & live).alias("active"), F.count_if(F.col("enabled") & ~live).alias("expired"), F.count_if(~F.col("enabled")).alias("disabled"))


@query(
    "p18_kill_chain_phase",
    f"""WITH {DET_SQL} SELECT event_id, CASE event_type WHEN 'process' THEN 'exploitation' WHEN 'network' THEN 'command_and_control' WHEN 'file' THEN 'actions_on_objectives' ELSE 'exploitation' END AS phase FROM det""",
)
def kill_chain_phase(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", triage.kill_chain_phase().alias("phase"))


#: Detections of a host and day are one incident here; correlation has its own queries.
_INC = DET_SQL + ", inc AS (SELECT *, host || '-' || CAST(floor(ts / 86400) AS BIGINT) AS incident_id FROM det)"


def host_days(spark, sf_dir, key="incident_id"):
    return detections(spark, sf_dir).withColumn(key, F.concat_ws("-", "host", F.floor(F.col("ts") / 86400).cast("string")))


@query(
    "w05_incident_timeline",
    f"""WITH {_INC}, l AS (SELECT *, lag(severity) OVER (PARTITION BY incident_id ORDER BY ts, event_id) AS was FROM inc)
    SELECT incident_id, ts, event_id, 'detection' AS kind, upper(severity) || ' ' || detector AS title FROM l
    UNION ALL SELECT incident_id, ts, event_id, 'escalation', 'severity ' || was || ' -> ' || severity FROM l WHERE severity <> was""",
)
def incident_timeline(spark, sf_dir):
    return triage.incident_timeline(host_days(spark, sf_dir))


@query(
    "w06_kill_chain_steps",
    f"""WITH {_INC} SELECT incident_id, string_agg(event_id || ':' || CASE event_type WHEN 'network' THEN 'command_and_control' WHEN 'file' THEN 'actions_on_objectives' ELSE 'exploitation' END, ',' ORDER BY ts, event_id) AS steps FROM inc GROUP BY 1""",
)
def kill_chain_steps(spark, sf_dir):
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["event_id"].cast("string"), s["phase"])), ",")
    return triage.kill_chain_steps(host_days(spark, sf_dir)).select("incident_id", steps.alias("steps"))


#: The fold is min(1, max over i of d_i + 0.15 (i + (i + 1) + ... + (n - 1))): later boosts add to what came before.
_GROUP_SQL = (
    _INC
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY incident_id) AS m FROM inc),
    grp AS (SELECT incident_id AS group_id, least(1.0, max(score + 0.15 * (m * (m - 1) / 2 - (n - 1) * (n - 2) / 2))) AS score, count(*) AS detections, min(ts) AS first_seen, max(ts) AS last_seen,
      list_sort(list(DISTINCT host)) AS hosts, max_by(severity || ' ' || detector, score) AS top FROM ranked GROUP BY 1)"""
)


@query("w12_group_score", f"WITH {_GROUP_SQL} SELECT group_id, round(score, 9) AS score, detections, first_seen, last_seen FROM grp")
def group_score(spark, sf_dir):
    return triage.group_scores(host_days(spark, sf_dir, "group_id")).select("group_id", F.round("score", 9).alias("score"), "detections", "first_seen", "last_seen")


@query(
    "a18_promote_incidents",
    f"""WITH {_GROUP_SQL} SELECT group_id, round(score, 9) AS score, detections, array_to_string(hosts, ',') AS hosts FROM grp WHERE score >= 0.55 OR detections >= 3""",
)
def promote_incidents(spark, sf_dir):
    return triage.promote_incidents(host_days(spark, sf_dir, "group_id")).select("group_id", F.round("score", 9).alias("score"), "detections", F.array_join("hosts", ",").alias("hosts"))


@query(
    "a17_incident_stats",
    f"""WITH {_GROUP_SQL}, s AS (SELECT CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM grp WHERE score >= 0.55 OR detections >= 3)
    SELECT severity, count(*) AS count FROM s GROUP BY 1""",
)
def incident_stats(spark, sf_dir):
    return triage.promote_incidents(host_days(spark, sf_dir, "group_id")).groupBy("severity").agg(F.count("*").alias("count"))


#: Cases as a view over customers, their logs over orders.
def custody_entries(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ts = F.unix_micros(F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone())) / F.lit(1e6) + F.col("o_orderkey") % 86400
    action = F.when(F.col("o_orderstatus") == "F", "assigned").when(F.col("o_orderstatus") == "O", "note_added").otherwise("status_changed")
    return orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("case_id"), ts.alias("ts"), action.alias("action"), F.lit("system").alias("actor"), F.col("o_orderpriority").alias("detail"))


@query("w10_append_custody")
def append_custody(spark, sf_dir):
    return triage.append_custody(custody_entries(spark, sf_dir))


@query("w09_verify_custody_chain", "SELECT 'c' || o_custkey AS case_id, o_custkey % 5 <> 0 OR count(*) < 2 AS valid FROM orders GROUP BY o_custkey")
def verify_custody_chain(spark, sf_dir):
    log = triage.append_custody(custody_entries(spark, sf_dir))
    # every fifth case's second entry was changed afterwards
    changed = (F.substring("case_id", 2, 20).cast("long") % 5 == 0) & (F.col("seq") == 2)
    return triage.verify_custody(log.withColumn("detail", F.when(changed, "changed").otherwise(F.col("detail"))))


_SLA_NOW = 883612800.0


@query(
    "w11_sla_status",
    f"""WITH log AS (SELECT 'c' || o_custkey AS case_id, epoch(o_orderdate) + o_orderkey % 86400 AS ts, CASE o_orderstatus WHEN 'F' THEN 'assigned' WHEN 'O' THEN 'note_added' ELSE 'status_changed' END AS action FROM orders),
    cs AS (SELECT case_id, min(ts) AS created_at, ['p1', 'p2', 'p3', 'p4'][1 + CAST(substr(case_id, 2) AS INT) % 4] AS priority, CASE WHEN CAST(substr(case_id, 2) AS INT) % 3 = 0 THEN max(ts) END AS closed_at,
      min(ts) FILTER (action IN ('assigned', 'status_changed')) AS responded FROM log GROUP BY 1),
    w AS (SELECT *, [15, 60, 240, 1440][CAST(priority[2] AS INT)] * 60 AS rw, [240, 1440, 4320, 10080][CAST(priority[2] AS INT)] * 60 AS sw, {_SLA_NOW} - created_at AS elapsed FROM cs)
    SELECT case_id, priority, CASE WHEN responded IS NULL THEN CASE WHEN elapsed >= rw THEN 'breached' WHEN elapsed >= rw * 0.8 THEN 'at_risk' ELSE 'on_track' END WHEN responded <= created_at + rw THEN 'met' ELSE 'breached' END AS response,
      CASE WHEN closed_at IS NULL THEN CASE WHEN elapsed >= sw THEN 'breached' WHEN elapsed >= sw * 0.8 THEN 'at_risk' ELSE 'on_track' END WHEN closed_at <= created_at + sw THEN 'met' ELSE 'breached' END AS resolution FROM w""",
)
def sla_status(spark, sf_dir):
    from pyspark.sql.window import Window

    log = custody_entries(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "action", "detail")))
    n = F.substring("case_id", 2, 20).cast("int")
    cases = log.groupBy("case_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last"))
    cases = cases.select("case_id", "created_at", F.concat(F.lit("p"), (1 + n % 4).cast("string")).alias("priority"), F.when(n % 3 == 0, F.col("last")).alias("closed_at"))
    return triage.sla_status(cases, log, _SLA_NOW)

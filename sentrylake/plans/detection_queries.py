"""Rules, hunts, store aggregates and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.severity import at_least
from ..operators import rules, store
from ..sources.standins import DET_SQL, SEC_SQL, detections, security_events
from .registry import query

#: The month that the events cover.
SINCE, UNTIL = 1704067200.0, 1706745600.0
DAY = 86400.0

_RULE_SQL = (
    SEC_SQL
    + r""", hit AS (
  SELECT *, list_filter([
    CASE WHEN event_type = 'process' AND regexp_matches(command_line, '(?i)\b(curl|wget|bash\s+-i|nc\s+-e|powershell|certutil|mshta)\b')
      THEN {'rule_id': 'T1059.LIVING_OFF_THE_LAND', 'name': 'Living-off-the-land binary execution', 'score': 0.7::DOUBLE, 'severity': 'medium'} END,
    CASE WHEN regexp_matches(command_line, '(?i)(?:base64|-enc(?:oded)?)\s+[A-Za-z0-9+/=]{40,}')
      THEN {'rule_id': 'T1027.ENCODED_PAYLOAD', 'name': 'Encoded payload in command line', 'score': 0.85::DOUBLE, 'severity': 'high'} END,
    CASE WHEN event_type = 'process' AND process IN ('cmd.exe', 'bash', 'sh', 'powershell.exe', 'pwsh') AND length(command_line) > 0
      THEN {'rule_id': 'T1055.SUSPICIOUS_PARENT', 'name': 'Shell spawned from Office/Browser parent', 'score': 0.9::DOUBLE, 'severity': 'high'} END,
    CASE WHEN regexp_matches(message, '(?i)failed (login|password) for (root|admin)')
      THEN {'rule_id': 'T1078.ROOT_LOGIN_FAILED', 'name': 'Failed root/admin login', 'score': 0.65::DOUBLE, 'severity': 'medium'} END,
    CASE WHEN event_type = 'network' AND dst_port NOT IN (80, 443, 53, 22, 3389)
      THEN {'rule_id': 'T1071.EXTERNAL_BEACON', 'name': 'Outbound connection on rare port', 'score': 0.6::DOUBLE, 'severity': 'medium'} END,
    CASE WHEN event_type = 'file' AND regexp_matches(file_path, '(?i)\.(locked|encrypted|crypted|crypt|wnry|cerber)$')
      THEN {'rule_id': 'T1486.RANSOMWARE_EXT', 'name': 'Ransomware-style file extension write', 'score': 0.95::DOUBLE, 'severity': 'critical'} END,
    CASE WHEN event_type = 'network' AND bytes_sent > 50000000
      THEN {'rule_id': 'HEURISTIC.LARGE_EGRESS', 'name': 'Large outbound transfer', 'score': 0.55::DOUBLE, 'severity': 'medium'} END,
    CASE WHEN event_type = 'process' AND regexp_matches(command_line, '(?i)/tmp/')
      THEN {'rule_id': 'HEURISTIC.TMP_EXEC', 'name': 'Execution from temp/world-writable directory', 'score': 0.7::DOUBLE, 'severity': 'medium'} END
  ], lambda x: x IS NOT NULL) AS hits FROM sec)"""
)


@query("f08_rule_pack_hits", f"WITH {_RULE_SQL}, one AS (SELECT unnest(hits) AS h FROM hit) SELECT h.rule_id AS rule_id, count(*) AS hits FROM one GROUP BY 1")
def rule_pack_hits(spark, sf_dir):
    hits = security_events(spark, sf_dir).select(F.explode(rules.rule_hits()).alias("h"))
    return hits.groupBy("h.rule_id").agg(F.count("*").alias("hits"))


@query(
    "a01_combine_rule_hits",
    f"""WITH {_RULE_SQL}, hitting AS (SELECT *, list_max(list_transform(hits, lambda x: x.score)) AS best FROM hit WHERE len(hits) > 0)
    SELECT event_id, round(least(1.0, best + 0.05 * (len(hits) - 1)), 6) AS score, list_filter(hits, lambda x: x.score = best)[1].severity AS severity,
      array_to_string(list_transform(hits, lambda x: x.rule_id || ': ' || x.name), '; ') AS reasons, len(hits) AS rule_count FROM hitting""",
)
def combine_rule_hits(spark, sf_dir):
    found = rules.rule_detections(security_events(spark, sf_dir))
    return found.select("event_id", F.round("score", 6).alias("score"), "severity", F.array_join("reasons", "; ").alias("reasons"), F.col("rule_count").cast("long").alias("rule_count"))


@query(
    "f01_f07_rule_matchers",
    f"""WITH {SEC_SQL} SELECT event_id FROM sec WHERE event_type = 'network' AND host IN ('h1', 'h2', 'h3') AND bytes_sent >= 100000 AND dst_port NOT IN (80, 443)
      AND regexp_matches(command_line, '(?i)LS -') AND message IS NOT NULL""",
)
def rule_matchers(spark, sf_dir):
    where = {
        "event_type": P.equals("NETWORK"),
        "host": P.one_of("H1", "h2", "h3"),
        "bytes_sent": P.compare(">=", 100000),
        "dst_port": P.not_in(80, 443),
        "command_line": P.regex("LS -"),
        "": lambda: F.col("message").isNotNull(),
    }
    return security_events(spark, sf_dir).where(P.rule_matches(where)).select("event_id")


@query(
    "f18_structured_selections",
    f"""WITH {SEC_SQL} SELECT event_id, "user" FROM sec WHERE (lower(command_line) LIKE '%curl%' AND lower(command_line) LIKE '%evil%' AND lower(command_line) LIKE '%.example.com%')
      OR (starts_with(lower(file_path), '/data/f1') AND ends_with(lower(file_path), '.locked') AND lower(status) IN ('failure', 'error'))""",
)
def structured_selections(spark, sf_dir):
    branches = [
        {"command_line|contains|all": ["CURL", "evil", ".example.com"]},
        {"file_path|startswith": "/DATA/f1", "file_path|endswith": ".locked", "status": ["Failure", "error"]},
    ]
    return security_events(spark, sf_dir).where(P.selections(branches)).select("event_id", "user")


@query(
    "f09_f15_hunt_predicates",
    f"""WITH {SEC_SQL} SELECT count(*) FILTER (dst_port > 50) AS port_above, count(*) FILTER (message IS NULL OR message <> 'session opened') AS message_differs,
      count(*) FILTER (message = 'session opened') AS message_same, count(*) FILTER (message IS NULL OR message NOT IN ('session opened')) AS not_in_list,
      count(*) FILTER (message IS NULL OR message NOT LIKE 'failed%') AS not_like, count(*) FILTER (message IS NULL OR NOT regexp_matches(message, 'ro+t')) AS not_regex,
      count(*) FILTER (value NOT BETWEEN 100 AND 200) AS not_between, count(*) FILTER (message IS NULL) AS no_message,
      count(*) FILTER (host LIKE 'h1_' AND NOT (coalesce(message = 'session opened', false)) ) AS and_not, count(*) FILTER (CAST("user" AS DOUBLE) < 10) AS user_number FROM sec""",
)
def hunt_predicates(spark, sf_dir):
    m, c = F.col("message"), F.col
    return security_events(spark, sf_dir).agg(
        F.count_if(P.hunt_compare(c("dst_port"), ">", 50)).alias("port_above"),
        F.count_if(P.hunt_compare(m, "!=", "session opened")).alias("message_differs"),
        F.count_if(P.hunt_compare(m, "==", "session opened")).alias("message_same"),
        F.count_if(P.hunt_in(m, ["session opened"], negate=True)).alias("not_in_list"),
        F.count_if(P.hunt_like(m, "failed%", negate=True)).alias("not_like"),
        F.count_if(P.hunt_regex(m, "ro+t", negate=True)).alias("not_regex"),
        F.count_if(P.hunt_between(c("value"), 100, 200, negate=True)).alias("not_between"),
        F.count_if(P.hunt_exists(m)).alias("no_message"),
        F.count_if(P.hunt_and(P.hunt_like(c("host"), "h1_"), P.hunt_not(m == "session opened"))).alias("and_not"),
        F.count_if(P.hunt_compare(c("user"), "<", 10)).alias("user_number"),
    )


@query("f16_hunt", f"WITH {SEC_SQL} SELECT event_id, host, ts FROM sec WHERE event_type = 'network' AND dst_port > 90 ORDER BY ts, event_id LIMIT 1000")
def hunt(spark, sf_dir):
    return P.hunt(security_events(spark, sf_dir), "event_type = 'network' and dst_port > 90").select("event_id", "host", "ts")


@query(
    "f17_run_saved_hunts",
    f"""WITH {SEC_SQL} SELECT 'locked files' AS hunt_id, count(*) AS scanned, count(*) FILTER (file_path LIKE '%.locked') AS matched FROM sec
    UNION ALL SELECT 'root failures', count(*), count(*) FILTER (message LIKE 'failed%root') FROM sec
    UNION ALL SELECT 'nothing', count(*), 0 FROM sec""",
)
def run_saved_hunts(spark, sf_dir):
    return P.run_hunts(security_events(spark, sf_dir), {"locked files": "file_path like '%.locked'", "root failures": "message like 'failed%root'", "nothing": "host = 'nowhere'"})


@query(
    "a04_detections_histogram",
    f"""WITH {DET_SQL}, n AS (SELECT CAST(floor((ts - {SINCE}) / {DAY}) AS BIGINT) AS bin, severity FROM det WHERE ts >= {SINCE} AND ts <= {UNTIL}),
    c AS (SELECT bin, count(*) AS count, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high,
      count(*) FILTER (severity = 'critical') AS critical FROM n GROUP BY 1)
    SELECT r.bin, {SINCE} + r.bin * {DAY} AS bin_ts, coalesce(count, 0) AS count, coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high, coalesce(critical, 0) AS critical
    FROM (SELECT unnest(range(31)) AS bin) r LEFT JOIN c USING (bin)""",
)
def detections_histogram(spark, sf_dir):
    return store.detections_histogram(detections(spark, sf_dir), SINCE, UNTIL, DAY)


@query("a05_top_detectors", f"WITH {DET_SQL} SELECT detector, count(*) AS count FROM det GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_detectors(spark, sf_dir):
    return store.top_counts(detections(spark, sf_dir), "detector", 3)


@query("a06_top_hosts", f"WITH {DET_SQL} SELECT host, count(*) AS count FROM det GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_hosts(spark, sf_dir):
    return store.top_counts(detections(spark, sf_dir), "host", 10)


@query(
    "a07_severity_breakdown",
    f"WITH {DET_SQL} SELECT s.severity, count(event_id) AS count FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity) s LEFT JOIN (SELECT * FROM det WHERE host = 'h7' AND score < 0.8) d ON d.severity = s.severity GROUP BY 1",
)
def severity_breakdown(spark, sf_dir):
    return store.severity_breakdown(detections(spark, sf_dir).where("host = 'h7' and score < 0.8"))


@query("a08_event_volume_by_type", f"WITH {SEC_SQL} SELECT event_type, count(*) AS count FROM sec GROUP BY 1")
def event_volume_by_type(spark, sf_dir):
    return store.counts_by(security_events(spark, sf_dir), "event_type")


@query(
    "a09_store_stats",
    f"""WITH {DET_SQL} SELECT 'events' AS "table", count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM sec
    UNION ALL SELECT 'detections', count(*), min(ts), max(ts) FROM det WHERE severity = 'critical'""",
)
def store_stats(spark, sf_dir):
    return store.store_stats(events=security_events(spark, sf_dir), detections=detections(spark, sf_dir).where("severity = 'critical'"))


@query(
    "a12_pipeline_metrics",
    f"""WITH {DET_SQL} SELECT 'severity' AS dimension, severity AS value, count(*) AS count FROM det GROUP BY 2 UNION ALL SELECT 'detector', detector, count(*) FROM det GROUP BY 2
    UNION ALL SELECT 'total', NULL, count(*) FROM det""",
)
def pipeline_metrics(spark, sf_dir):
    return store.counts_by_each(detections(spark, sf_dir), "severity", "detector")


@query(
    "a30_summary_section",
    f"""WITH {DET_SQL}, e AS (SELECT count(*) AS events, count(DISTINCT host) AS hosts FROM sec), d AS (SELECT count(*) AS detections FROM det WHERE score >= 0.5)
    SELECT events, detections, hosts, detections / {(UNTIL - SINCE) / 3600}::DOUBLE AS detections_per_hour, detections / events AS alert_ratio FROM e, d""",
)
def summary_section(spark, sf_dir):
    return store.summary(security_events(spark, sf_dir), detections(spark, sf_dir).where("score >= 0.5"), SINCE, UNTIL)


@query(
    "a31_detection_section",
    f"WITH {DET_SQL} SELECT detector, count(*) AS count, round(avg(score) FILTER (score > 0), 9) AS mean_score, max(score) AS max_score FROM det GROUP BY 1",
)
def detection_section(spark, sf_dir):
    return store.score_summary(detections(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 9))


@query(
    "a33_trend_direction",
    f"""WITH {DET_SQL}, c AS (SELECT count(*) FILTER (ts < {SINCE + (UNTIL - SINCE) / 2}) AS first_half, count(*) FILTER (ts >= {SINCE + (UNTIL - SINCE) / 2}) AS second_half FROM det)
    SELECT *, CASE WHEN second_half > first_half * 1.25 THEN 'increasing' WHEN second_half < first_half * 0.75 THEN 'decreasing' ELSE 'stable' END AS direction FROM c""",
)
def trend_direction(spark, sf_dir):
    return store.trend_direction(detections(spark, sf_dir), SINCE, UNTIL)


@query(
    "f22_forensics_filter",
    f"WITH {DET_SQL} SELECT event_id, ts, host, detector, severity FROM det WHERE ts BETWEEN {SINCE + 5 * DAY} AND {SINCE + 20 * DAY} AND host = 'h3' AND severity = 'high' ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def forensics_filter(spark, sf_dir):
    rows = store.in_range(detections(spark, sf_dir), SINCE + 5 * DAY, SINCE + 20 * DAY)
    return store.newest(rows, 50, (F.col("host") == "h3") & (F.col("severity") == "high")).select("event_id", "ts", "host", "detector", "severity")


@query("f20_severity_floor", f"WITH {DET_SQL} SELECT event_id, severity FROM det WHERE severity IN ('high', 'critical')")
def severity_floor(spark, sf_dir):
    return detections(spark, sf_dir).where(at_least(F.col("severity"), "high")).select("event_id", "severity")


@query("t04_recent_detections", f"WITH {DET_SQL} SELECT event_id, ts FROM det ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_detections(spark, sf_dir):
    return store.newest(detections(spark, sf_dir), 100).select("event_id", "ts")


@query("f27_page_of_a_list", f"WITH {DET_SQL} SELECT event_id, ts FROM det WHERE severity = 'critical' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def page_of_a_list(spark, sf_dir):
    return store.newest(detections(spark, sf_dir), 20, F.col("severity") == "critical", offset=40).select("event_id", "ts")


@query(
    "f30_retention",
    f"""WITH {DET_SQL} SELECT severity, count(*) AS kept FROM det WHERE {UNTIL} - ts <= CASE severity WHEN 'low' THEN 7 WHEN 'medium' THEN 30 WHEN 'high' THEN 90 ELSE 365 END * 86400.0 GROUP BY 1""",
)
def retention(spark, sf_dir):
    return store.retain(detections(spark, sf_dir), UNTIL).groupBy("severity").agg(F.count("*").alias("kept"))


@query(
    "s18_append_events",
    f"WITH {SEC_SQL} SELECT event_id, host FROM sec WHERE NOT coalesce(pid % 2 = 0, false)",
)
def append_events(spark, sf_dir):
    events = security_events(spark, sf_dir)
    arriving = events.select("event_id", "host")
    return store.append_new(events.where("pid % 2 = 0"), arriving.unionByName(arriving), "event_id")


@query(
    "s19_append_detections",
    f"WITH {DET_SQL} SELECT event_id || ':' || detector AS uid, score FROM det WHERE severity <> 'low'",
)
def append_detections(spark, sf_dir):
    rows = detections(spark, sf_dir).select(store.detection_uid().alias("uid"), "score", "severity")
    return store.append_new(rows.where("severity = 'low'").drop("severity"), rows.drop("severity").unionByName(rows.where("score > 0.7").drop("severity")), "uid")


@query("w13_rate_limit")
def rate_limit(spark, sf_dir):
    # hours stand for minutes, so that the limit is reached
    limited = store.rate_limited(detections(spark, sf_dir).withColumn("ts", F.col("ts") / 60), 2, "detector", "medium")
    return limited.groupBy("detector").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("dropped"))

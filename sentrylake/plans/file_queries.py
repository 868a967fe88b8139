"""Readers and writers: a given table is written in a format to the shared folder and read back by the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.checkpoints import new_path
from ..functions.severity import at_least
from ..operators import coverage, ml, rules, store, traces, triage
from ..sources import files
from ..sources.standins import DET_SQL, SEC_SQL, detections, security_events, table
from ..streaming import follow, streams
from .ingest_queries import LINES_SQL, raw_lines
from .registry import query
from .trace_queries import NUMBERS, TRACE_SQL, trace



def _text(df, name, **options):
    path = new_path(df.sparkSession, name)
    df.write.options(**options).text(path)
    return path


def _json(df, name):
    return _text(df.select(F.to_json(F.struct(*df.columns)).alias("value")), name)


@query("s01_read_event_jsonl", f"WITH {SEC_SQL} SELECT 'm' || event_id AS message, lower(host) AS host, process, pid, floor(ts) AS \"timestamp\", 'process' AS event_type FROM sec")
def read_event_jsonl(spark, sf_dir):
    e = security_events(spark, sf_dir)
    json = F.to_json(F.struct(F.floor("ts").cast("long").alias("ts"), F.col("host").alias("hostname"), F.struct(F.col("process").alias("name"), F.col("pid").cast("string").alias("pid")).alias("process"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message")))
    lines = e.select(F.explode(F.array(json, F.lit("no json"), F.lit("[1]"))).alias("value"))
    return files.read_event_jsonl(spark, _text(lines, "s01", compression="gzip")).select("message", F.lower("host").alias("host"), "process", "pid", "timestamp", "event_type")


@query("s02_stream_log_lines", f"WITH {LINES_SQL} SELECT line FROM lines")
def stream_log_lines(spark, sf_dir):
    folder = _text(raw_lines(spark, sf_dir).select(F.col("line").alias("value")), "s02")
    out, state = streams.folders(spark)
    streams.run_available(streams.read_lines(spark, folder, 4), streams.batch_sink(out), state)
    return spark.read.parquet(out).select("line")


@query("s02_follow_lines", f"WITH {LINES_SQL} SELECT line FROM lines")
def follow_log_lines(spark, sf_dir):
    lines = raw_lines(spark, sf_dir).select(F.col("line").alias("value"), "event_id")
    path, (out, state) = new_path(spark, "s02"), streams.folders(spark)
    # two runs of one query, with more lines between them
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        lines.where(part).select("value").write.mode("append").text(path)
        streams.run_available(follow.follow_lines(spark, path, range_bytes=1 << 20), streams.batch_sink(out), state)
    return spark.read.parquet(out).select("line")


@query("s03_read_cdm_events", f"""WITH {TRACE_SQL} SELECT 'a' || sk AS "actorID", 'o' || pk AS "objectID", 'EVENT_' || action AS action, CAST(seq AS VARCHAR) AS "timestampNanos", coalesce(exec, '') AS exec, path, 'u7' AS userid FROM tr WHERE pk % 9 <> 0""")
def read_cdm_events(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    uuid = lambda c: F.struct(c.alias("com.bbn.tc.schema.avro.cdm20.UUID"))
    path = F.when(F.col("path").isNotNull(), F.struct(F.col("path").alias("string")))
    event = F.struct(
        F.concat(F.lit("EVENT_"), "action").alias("type"), s("seq").alias("timestampNanos"), uuid(F.concat(F.lit("a"), s("sk"))).alias("subject"), uuid(F.concat(F.lit("o"), s("pk"))).alias("predicateObject"),
        F.struct(F.struct("exec").alias("map")).alias("properties"), path.alias("predicateObjectPath"), F.when(F.col("pk") % 9 == 0, "FILE_OBJECT_DIR").alias("kind"),
    )
    doc = F.to_json(F.struct(F.struct(event.alias("com.bbn.tc.schema.avro.cdm20.Event")).alias("datum"), F.lit("u7").alias("userId")))
    found = files.read_cdm_events(spark, _text(trace(spark, sf_dir).select(doc.alias("value")), "s03", compression="gzip", maxRecordsPerFile=500_000))
    return found.select("actorID", "objectID", "action", "timestampNanos", "exec", F.try_element_at("properties", F.lit("objectpath")).alias("path"), "userid")


@query("s04_read_labelled_tsv", f"""WITH {TRACE_SQL} SELECT 'a' || sk AS "actorID", 'o' || pk AS "objectID", action, CAST(seq AS VARCHAR) AS "timestamp" FROM tr WHERE path IS NOT NULL""")
def read_labelled_tsv(spark, sf_dir):
    row = trace(spark, sf_dir).select(F.concat(F.lit("a"), F.col("sk").cast("string")), F.lit("P"), F.concat(F.lit("o"), F.col("pk").cast("string")), F.when(F.col("path").isNotNull(), F.lit("F")), "action", F.col("seq").cast("string"))
    path = new_path(spark, "s04")
    row.write.csv(path, sep="\t")
    return files.read_labelled_tsv(spark, path).select("actorID", "objectID", "action", "timestamp")


@query("s05_read_trace_parquet", f"WITH {SEC_SQL} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(ts) END AS at FROM sec")
def read_trace_parquet(spark, sf_dir):
    path = new_path(spark, "s05")
    when = F.when(F.col("event_id") % 5 == 0, F.lit("no time")).otherwise(F.timestamp_seconds(F.floor("ts").cast("long")).cast("string"))
    security_events(spark, sf_dir).select("event_id", when.alias("timestamp")).write.parquet(path)
    return files.read_trace_parquet(spark, path).select("event_id", F.unix_timestamp("timestamp").cast("double").alias("at"))


@query("s06_read_concatenated_json", f"WITH {SEC_SQL} SELECT event_id, host, pid FROM sec")
def read_concatenated_json(spark, sf_dir):
    json = F.to_json(F.struct("event_id", "host", F.struct("pid").alias("p")))
    # forty objects follow each other in a row
    glued = security_events(spark, sf_dir).select(F.floor(F.col("event_id") / 40).alias("g"), json.alias("j")).groupBy("g").agg(F.array_join(F.collect_list("j"), "").alias("value")).select("value")
    return files.read_concatenated_json(spark, _text(glued, "s06"), "event_id long, host string, p struct<pid:int>").select("event_id", "host", "p.pid")


@query("s07_read_etw_json", f"WITH {SEC_SQL} SELECT event_id AS \"TimeStamp\", 'FileIO' || action AS event, pid AS \"PID\", file_path AS file FROM sec")
def read_etw_json(spark, sf_dir):
    root = new_path(spark, "s07")
    rows = security_events(spark, sf_dir).select(F.concat(F.lit("FileIO"), "action").alias("Event"), F.col("pid").cast("long").alias("PID"), F.create_map(F.lit("FileName"), "file_path").alias("args"), F.col("event_id").alias("TimeStamp"))
    for k in (0, 1):
        rows.where(F.col("PID") % 2 == k).write.json(f"{root}/host{k}/day")
    return files.read_etw_json(spark, root).select("TimeStamp", F.col("Event").alias("event"), "PID", F.col("args")["FileName"].alias("file"))


@query("s08_read_workstation_trace", f"WITH {SEC_SQL} SELECT action, 'a' || pid AS \"actorID\", pid, file_path AS path, CAST(event_id AS VARCHAR) AS \"timestamp\" FROM sec")
def read_workstation_trace(spark, sf_dir):
    rows = security_events(spark, sf_dir).select("action", F.concat(F.lit("a"), F.col("pid").cast("string")).alias("actorID"), F.col("pid").cast("long").alias("pid"), F.create_map(F.lit("path"), "file_path").alias("properties"), F.col("event_id").cast("string").alias("timestamp"))
    return files.read_workstation_trace(spark, _json(rows, "s08")).select("action", "actorID", "pid", F.col("properties")["path"].alias("path"), "timestamp")


#: Indicators from customers: an address, a name of a host or a hash, with a score.
_IOC = """(SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '10.1.' || (c_custkey % 250) || '.' || (c_custkey % 97) WHEN 1 THEN 'host' || c_custkey || '.example.com' ELSE md5(c_name) END AS value,
    ['ip', 'domain', 'hash_md5'][1 + c_custkey % 3] AS type, round(c_custkey % 100 / 100.0, 2) AS score FROM customer)"""


def _indicators(spark, sf_dir):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    value = F.when(k % 3 == 0, F.concat(F.lit("10.1."), s(k % 250), F.lit("."), s(k % 97))).when(k % 3 == 1, F.concat(F.lit("host"), s(k), F.lit(".example.com"))).otherwise(F.md5("c_name"))
    return table(spark, sf_dir, "customer").select(value.alias("value"), F.round(k % 100 / 100.0, 2).alias("score"))


_FEED_SQL = f"SELECT type, value, 0.8 AS confidence, score AS threat_score FROM {_IOC}"
_FEED = ("type", "value", "confidence", "threat_score")


def _load(spark, df, suffix):
    path = new_path(spark, "feed") + suffix
    df.write.text(path)
    return files.load_feed(spark, path)


@query("s09_load_feed_csv", f"SELECT type, value, 0.8 AS confidence, score AS threat_score, ['a', 'b'] AS tags FROM {_IOC}")
def load_feed_csv(spark, sf_dir):
    path = new_path(spark, "feed") + ".csv"
    _indicators(spark, sf_dir).select(F.col("value").alias("indicator"), "score", F.lit("a; b").alias("labels")).write.csv(path, header=True)
    return files.load_feed_csv(spark, path).select(*_FEED, "tags")


@query("s10_load_feed_json", _FEED_SQL)
def load_feed_json(spark, sf_dir):
    # one document for each thousandth of the indicators
    rows = _indicators(spark, sf_dir).select(F.pmod(F.xxhash64("value"), F.lit(50)).alias("g"), F.struct("value", F.col("score").alias("threat_score")).alias("i"))
    docs = rows.groupBy("g").agg(F.collect_list("i").alias("iocs"))
    doc = F.when(F.col("g") % 2 == 0, F.to_json(F.struct("iocs"))).otherwise(F.to_json("iocs"))
    path = new_path(spark, "feed")
    docs.select("g", doc.alias("value")).repartition(50, "g").write.partitionBy("g").text(path)
    return files.load_feed_json(spark, f"{path}/g=*").select(*_FEED)


@query("s11_load_feed_jsonl", _FEED_SQL)
def load_feed_jsonl(spark, sf_dir):
    line = F.to_json(F.struct("value", F.col("score").alias("threat_score")))
    rows = _indicators(spark, sf_dir).select(F.explode(F.array(line, F.lit("# a comment"), F.lit(" "), F.lit("{bad"))).alias("value"))
    path = new_path(spark, "feed")
    rows.write.text(path)
    return files.load_feed_jsonl(spark, path).select(*_FEED)


@query("s12_load_feed_stix", f"SELECT CASE type WHEN 'hash_md5' THEN 'hash_sha256' ELSE type END AS type, value, round(floor(score * 100) / 100, 2) AS confidence FROM {_IOC} UNION ALL SELECT 'domain', 'second.example.com', round(floor(score * 100) / 100, 2) FROM {_IOC}")
def load_feed_stix(spark, sf_dir):
    kind = F.when(F.col("value").startswith("10."), "ipv4-addr:value").when(F.col("value").startswith("host"), "domain-name:value").otherwise("file:hash")
    pattern = F.concat(F.lit("["), kind, F.lit(" = '"), "value", F.lit("'] OR [domain-name:value = 'second.example.com']"))
    rows = _indicators(spark, sf_dir).select(F.pmod(F.xxhash64("value"), F.lit(40)).alias("g"), F.struct(pattern.alias("pattern"), F.floor(F.col("score") * 100).alias("confidence")).alias("i"))
    docs = rows.groupBy("g").agg(F.collect_list("i").alias("indicators")).select("g", F.to_json(F.struct("indicators")).alias("value"))
    path = new_path(spark, "feed")
    docs.repartition(40, "g").write.partitionBy("g").text(path)
    return files.load_feed_stix(spark, f"{path}/g=*").select("type", "value", F.round("confidence", 2).alias("confidence"))


@query("s13_load_feed_hosts", f"SELECT type, value FROM {_IOC}")
def load_feed_hosts(spark, sf_dir):
    lines = _indicators(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit("0.0.0.0  "), "value", F.lit(" # seen")), F.lit("# nothing"))).alias("value"))
    path = new_path(spark, "feed")
    lines.write.text(path)
    return files.load_feed_hosts(spark, path).select("type", "value")


@query("s14_load_feed", f"SELECT type, value FROM {_IOC} UNION ALL SELECT type, value FROM {_IOC}")
def load_feed(spark, sf_dir):
    rows = _indicators(spark, sf_dir)
    by_line = _load(spark, rows.select(F.to_json(F.struct("value")).alias("value")), ".ndjson")
    return by_line.select("type", "value").unionByName(_load(spark, rows.select("value"), ".list").select("type", "value"))


@query("s15_load_rules", f"WITH {SEC_SQL} SELECT event_id, list_filter([CASE WHEN event_type = 'process' AND pid > 250 THEN 'R1' END, CASE WHEN host IN ('h1', 'h2') AND regexp_matches(command_line, 'evil[0-9]+') THEN 'R2' END], lambda x: x IS NOT NULL) AS rules FROM sec WHERE (event_type = 'process' AND pid > 250) OR (host IN ('h1', 'h2') AND regexp_matches(command_line, 'evil[0-9]+'))")
def load_rules(spark, sf_dir):
    told = '[{"id": "R1", "where": {"event_type": "process", "pid": {"op": ">", "value": 250}}}, {"id": "R2", "where": {"host": ["h1", "h2"], "command_line": {"regex": "evil[0-9]+"}}}]'
    hits = rules.rule_hits(files.load_rules(told))
    return security_events(spark, sf_dir).select("event_id", F.array_sort(F.transform(hits, lambda h: h["rule_id"])).alias("rules")).where(F.size("rules") > 0)


_TECH = "(SELECT 'T' || (999 + s_suppkey) AS technique_id, s_name AS name, ['tactic' || (s_suppkey % 5)] AS tactics FROM supplier)"


def _bundle(spark, sf_dir):
    k = F.col("s_suppkey")
    t = F.concat(F.lit("T"), (999 + k).cast("string"))
    obj = F.struct(F.lit("attack-pattern").alias("type"), F.col("s_name").alias("name"), F.array(F.struct(t.alias("external_id"))).alias("external_references"), F.array(F.struct(F.concat(F.lit("tactic"), (k % 5).cast("string")).alias("phase_name"))).alias("kill_chain_phases"))
    docs = table(spark, sf_dir, "supplier").select((k % 10).alias("g"), obj.alias("o")).groupBy("g").agg(F.collect_list("o").alias("objects"))
    path = new_path(spark, "s16")
    docs.select("g", F.to_json(F.struct("objects")).alias("value")).repartition(10, "g").write.partitionBy("g").text(path)
    return files.load_technique_bundle(spark, f"{path}/g=*")


@query("s16_load_technique_bundle", f"SELECT * FROM {_TECH}")
def load_technique_bundle(spark, sf_dir):
    return _bundle(spark, sf_dir).select("technique_id", "name", "tactics")


@query("f29_technique_search", f"SELECT technique_id FROM {_TECH} WHERE contains(lower(technique_id), '10') OR contains(lower(name), '10')")
def technique_search(spark, sf_dir):
    return coverage.technique_search(_bundle(spark, sf_dir).withColumn("description", F.lit(None).cast("string")), "10").select("technique_id")


@query("f29_techniques_of_a_tactic", f"SELECT technique_id FROM {_TECH} WHERE list_contains(tactics, 'tactic3')")
def techniques_of(spark, sf_dir):
    return coverage.techniques_of(_bundle(spark, sf_dir), "tactic3").select("technique_id")


_SUPPRESS = "(SELECT 's' || n_nationkey AS rule_id, 'host' AS field, CASE WHEN n_nationkey % 2 = 0 THEN 'h1*' ELSE 'h' || (n_nationkey % 20) END AS pattern, n_nationkey % 4 <> 3 AS enabled FROM nation)"


def _suppressions(spark, sf_dir):
    k = F.col("n_nationkey")
    pattern = F.when(k % 2 == 0, F.lit("h1*")).otherwise(F.concat(F.lit("h"), (k % 20).cast("string")))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), k.cast("string")).alias("rule_id"), F.create_map(F.lit("host"), pattern).alias("match"), k.cast("double").alias("created_at"), (k % 4 != 3).alias("enabled"))
    path = new_path(spark, "s17")
    files.export_jsonl(rows.unionByName(rows.withColumn("rule_id", F.lit(None).cast("string"))), path)
    return files.load_suppressions(spark, path)


@query("s17_suppressions", f"SELECT rule_id, field, pattern, enabled FROM {_SUPPRESS}")
def suppressions(spark, sf_dir):
    return _suppressions(spark, sf_dir).select("rule_id", "field", "pattern", "enabled")


@query("f19_suppression_match", f"WITH {DET_SQL}, m AS (SELECT event_id, max_by(rule_id, CAST(substr(rule_id, 2) AS INT)) AS suppressed_by FROM det JOIN {_SUPPRESS} r ON enabled AND (host = pattern OR (pattern = 'h1*' AND starts_with(host, 'h1'))) GROUP BY 1) SELECT event_id, suppressed_by FROM det JOIN m USING (event_id)")
def suppression_match(spark, sf_dir):
    return triage.apply_suppressions(detections(spark, sf_dir), _suppressions(spark, sf_dir)).where("suppressed_by is not null").select("event_id", "suppressed_by")


_SNAP = "SELECT host AS incident_id, floor(ts / 86400) AS snapshot, max(ts) AS ts, count(*) AS detections FROM det GROUP BY 1, 2"


def _snapshots(spark, sf_dir):
    rows = detections(spark, sf_dir).groupBy(F.col("host").alias("incident_id"), F.floor(F.col("ts") / 86400).alias("snapshot")).agg(F.max("ts").alias("ts"), F.count("*").alias("detections"))
    path = new_path(spark, "s20")
    for k in (0, 1):  # a second append adds to the first
        files.append_snapshots(rows.where(F.col("snapshot") % 2 == k), path)
    return spark.read.parquet(path)


@query("s20_append_incident_snapshots", f"WITH {DET_SQL} {_SNAP}")
def append_snapshots(spark, sf_dir):
    return _snapshots(spark, sf_dir)


@query("t06_incident_history", f"WITH {DET_SQL}, s AS ({_SNAP}) SELECT * FROM s WHERE incident_id = 'h3' ORDER BY ts")
def incident_history(spark, sf_dir):
    return store.incident_history(_snapshots(spark, sf_dir), "h3")


@query("s21_export_jsonl", f"WITH {DET_SQL} SELECT event_id, host, score, tags FROM det")
def export_jsonl(spark, sf_dir):
    path = new_path(spark, "s21")
    files.export_jsonl(detections(spark, sf_dir).select("event_id", "host", "score", "tags"), path)
    return spark.read.schema("event_id long, host string, score double, tags array<string>").json(path)


@query("s22_export_csv", f"WITH {DET_SQL} SELECT event_id, host, '[\"' || array_to_string(tags, '\",\"') || '\"]' AS tags FROM det")
def export_csv(spark, sf_dir):
    path = new_path(spark, "s22")
    files.export_csv(detections(spark, sf_dir), path, ["event_id", "host", "tags"])
    return spark.read.csv(path, header=True, schema="event_id long, host string, tags string", escape="\\")


@query("s23_export_bundle", f"WITH {DET_SQL} SELECT 'detections' AS \"table\", count(*) AS rows FROM det UNION ALL SELECT 'events', count(*) FROM sec WHERE host = 'h1'")
def export_bundle(spark, sf_dir):
    path = new_path(spark, "s23")
    files.export_bundle(path, payload="command_line", detections=detections(spark, sf_dir), events=security_events(spark, sf_dir).where("host = 'h1'"))
    return spark.read.schema("table string, rows long").json(f"{path}/manifest")


@query("s24_write_alerts", f"WITH {DET_SQL} SELECT event_id, host FROM det WHERE severity = 'critical'")
def write_alerts(spark, sf_dir):
    alerts = detections(spark, sf_dir)
    # one key for each alert: the floor decides, the rate limit admits
    admitted = store.rate_limited(alerts.withColumn("key", F.col("event_id")), 2, "key", "critical").where("admitted")
    path = new_path(spark, "s24")
    files.export_jsonl(alerts.join(admitted.select("event_id"), "event_id").where(at_least(F.col("severity"), "critical")).select("event_id", "host"), path)
    return spark.read.schema("event_id long, host string").json(path)


@query("s25_saved_model_scores_alike", f"WITH {SEC_SQL} SELECT count(*) AS rows, 0 AS differ, '64' AS trees FROM sec")
def saved_model(spark, sf_dir):
    x = ml.dense_numeric(security_events(spark, sf_dir), NUMBERS)
    path = new_path(spark, "s25")
    ml.save_model(ml.fit_isolation_forest(x), path, "1", trees=64)
    # what is fitted again from the same rows is the same model
    loaded, told = ml.load_model(spark, path, "1")
    a, b = ml.score_isolation_forest(x, ml.fit_isolation_forest(x)), ml.score_isolation_forest(x, loaded)
    both = a.join(b.select("event_id", F.col("score").alias("other")), "event_id")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("score") - F.col("other")) > 1e-12).alias("differ")).withColumn("trees", F.lit(told["trees"]))


@query("s28_s29_documents", f"WITH {DET_SQL} SELECT host AS id, count(*) AS n, max(score) AS worst FROM det GROUP BY 1")
def documents(spark, sf_dir):
    docs = detections(spark, sf_dir).groupBy(F.col("host").alias("id")).agg(F.collect_list(F.struct("event_id", "score")).alias("alerts"))
    # each document is a file; one without an id is left out again
    both = docs.select(F.col("id").alias("g"), F.to_json(F.struct("id", "alerts")).alias("value")).unionByName(docs.select(F.concat(F.lit("none-"), "id").alias("g"), F.to_json(F.struct("alerts")).alias("value")))
    path = new_path(spark, "s28")
    both.repartition("g").write.partitionBy("g").text(path)
    loaded = files.load_documents(spark, f"{path}/g=*", "id string, alerts array<struct<event_id:bigint,score:double>>", ("id",))
    return loaded.select("id", F.explode("alerts").alias("a")).groupBy("id").agg(F.count("*").alias("n"), F.max("a.score").alias("worst"))


@query("s30_embeddings", "SELECT count(*) AS rows, any_value('log') AS kind, any_value('16') AS size FROM embeddings WHERE vec_id % 2 = 0")
def embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    path = new_path(spark, "s30")
    files.save_embeddings(rows.withColumn("kind", F.when(F.col(rows.columns[0]) % 2 == 0, "log").otherwise("alert")), path, size=16)
    known = files.embeddings_metadata(spark, path)
    return files.load_embeddings(spark, path, "log").agg(F.count("*").alias("rows"), F.max("kind").alias("kind")).withColumn("size", F.lit(known["size"]))


_PARSED = ("timestamp", "host", "user", "process", "pid", "dst_ip", "dst_port", "action", "message")


def _parsed(spark, sf_dir, event):
    """Every line by one parser, which gives nulls for lines of other formats."""
    return raw_lines(spark, sf_dir).select("event_id", event.alias("e")).select("event_id", *(f"e.{c}" for c in _PARSED))


def _parsed_sql(kind, **columns):
    return f"WITH {SEC_SQL} SELECT event_id, " + ", ".join(f'CASE WHEN event_id % 5 = {kind} THEN {columns.get(c, "NULL")} END AS "{c}"' for c in _PARSED) + " FROM sec"


@query("p02_parse_json_events", _parsed_sql(0, timestamp="floor(ts)", host="host", process="process", pid="pid", dst_ip="dst_ip", dst_port="dst_port", action="action"))
def parse_json_events(spark, sf_dir):
    return _parsed(spark, sf_dir, parsing.parse_json(F.col("line")))


@query("p03_classify_event_type", f"WITH {SEC_SQL} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'auth' WHEN 1 THEN 'process' WHEN 2 THEN 'network' WHEN 3 THEN 'file' WHEN 4 THEN 'auth' ELSE 'unknown' END AS kind FROM sec")
def classify_event_type(spark, sf_dir):
    k = F.col("event_id") % 6
    has = lambda n, c: F.when(k == n, F.col(c))
    fields = {"process": has(1, "process"), "command_line": has(1, "command_line"), "src_ip": F.lit(None).cast("string"), "dst_ip": has(2, "dst_ip"), "file_path": has(3, "file_path"), "action": F.when(k == 4, F.lit("login")).otherwise(F.lit("x"))}
    return security_events(spark, sf_dir).select("event_id", parsing.classify(F.when(k == 0, F.lit("AUTH")), F.lit(None).cast("string"), fields).alias("kind"))


@query("p04_parse_syslog", _parsed_sql(1, timestamp="epoch(make_timestamp(2024, 1, CAST(1 + event_id % 28 AS BIGINT), event_id % 10, 15, 30))", host="host", process="'sshd'", pid="pid", message="coalesce(message, 'ok')"))
def parse_syslog(spark, sf_dir):
    return _parsed(spark, sf_dir, parsing.parse_syslog(F.col("line"), 2024))


@query("p05_parse_auditd", _parsed_sql(2, timestamp="floor(ts) + 0.5", user='"user"', process="process", pid="pid + 1", action="action"))
def parse_auditd(spark, sf_dir):
    return _parsed(spark, sf_dir, parsing.parse_auditd(F.col("line")))


@query("p06_parse_cef", _parsed_sql(3, timestamp="floor(ts)", user='"user"', dst_ip="dst_ip", dst_port="dst_port", action="action", message="action"))
def parse_cef(spark, sf_dir):
    return _parsed(spark, sf_dir, parsing.parse_cef(F.col("line")))


@query("w25_node_labels", f"WITH {TRACE_SQL}, e AS (SELECT seq, \"actorID\" AS node, exec AS name FROM tr UNION ALL SELECT seq, \"objectID\", path FROM tr) SELECT node, max_by(name, (seq, name)) FILTER (name IS NOT NULL OR true) AS name FROM e GROUP BY 1")
def node_labels(spark, sf_dir):
    return traces.node_labels(trace(spark, sf_dir))


@query("t02_top_n", f"WITH {DET_SQL} SELECT host, count(*) AS count FROM det WHERE host IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_n(spark, sf_dir):
    return store.top_counts(detections(spark, sf_dir), "host", 5)


@query("f31_model_versions", f"WITH {DET_SQL} SELECT event_id, ts FROM det WHERE detector = 'isolation_forest' ORDER BY ts DESC, event_id DESC LIMIT 30")
def model_versions(spark, sf_dir):
    return store.newest(detections(spark, sf_dir), 30, F.col("detector") == "isolation_forest").select("event_id", "ts")


@query("f32_indicators_of_a_type", f"SELECT value, score FROM {_IOC} WHERE type = 'domain' ORDER BY score DESC, value LIMIT 25")
def indicators_of_a_type(spark, sf_dir):
    rows = _indicators(spark, sf_dir)
    return store.newest(rows, 25, parsing.infer_ioc_type(F.col("value")) == "domain", order=[F.desc("score"), "value"]).select("value", "score")


@query("t05_in_order_of_time", f"WITH {SEC_SQL} SELECT event_id, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS place FROM sec")
def in_order_of_time(spark, sf_dir):
    return traces.in_order(security_events(spark, sf_dir), "host")


_NOW = 1706000000.0
_DUE = "(VALUES ('Daily Executive Report', 'executive', 86400.0::DOUBLE), ('Weekly Compliance Report', 'compliance', 604800.0::DOUBLE)) s(schedule, kind, every)"


@query(
    "x07_scheduled_reports",
    f"""WITH {DET_SQL} SELECT schedule, kind, {_NOW} - every AS since, {_NOW} AS until, {_NOW} + every AS next_run, (SELECT count(*) FROM sec WHERE ts BETWEEN {_NOW} - every AND {_NOW}) AS events,
    (SELECT count(*) FROM det WHERE ts BETWEEN {_NOW} - every AND {_NOW}) AS detections, (SELECT count(DISTINCT host) FROM sec WHERE ts BETWEEN {_NOW} - every AND {_NOW}) AS hosts,
    (SELECT count(*) FROM det WHERE severity = 'critical' AND ts BETWEEN {_NOW} - every AND {_NOW}) AS critical FROM {_DUE}""",
)
def scheduled_reports(spark, sf_dir):
    # the hourly report ran just before
    return store.scheduled_reports(security_events(spark, sf_dir), detections(spark, sf_dir), _NOW, {"Hourly Operational Report": _NOW - 60, "Daily Executive Report": _NOW - 90_000})

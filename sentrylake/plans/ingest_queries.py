"""Parsing, normalising and threat intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.severity import severity_from_score
from ..operators import intel
from ..sources.standins import DET_SQL, SEC_SQL, detections, security_events
from .registry import query

#: Raw lines of each format, made from the event view: by event number one of five kinds.
LINES_SQL = (
    SEC_SQL
    + """, lines AS (SELECT event_id, CASE event_id % 5
      WHEN 0 THEN '{"ts": ' || CAST(floor(ts) AS BIGINT) || ', "hostname": "' || host || '", "process": {"name": "' || process || '", "pid": ' || pid || '}, "destination": {"ip": "' || dst_ip || '", "port": "' || dst_port || '"}, "cmd": "ls", "event.action": "' || action || '"}'
      WHEN 1 THEN '<' || (event_id % 100) || '>Jan ' || (1 + event_id % 28) || ' 0' || (event_id % 10) || ':15:30 ' || host || ' sshd[' || pid || ']: ' || coalesce(message, 'ok')
      WHEN 2 THEN 'type=' || CASE WHEN pid % 2 = 0 THEN 'SYSCALL' ELSE 'USER_LOGIN' END || ' msg=audit(' || CAST(floor(ts) AS BIGINT) || '.5:' || event_id || '): pid=' || pid || ' uid="' || "user" || '" comm="' || process || '" op=' || action || ' pid=' || (pid + 1)
      WHEN 3 THEN 'CEF:0|acme|fw|1.0|' || dst_port || '|' || action || '|5|src=1.2.3.4 dst=' || dst_ip || ' dpt=' || dst_port || ' suser="' || "user" || '" rt=' || CAST(floor(ts) AS BIGINT) * 1000
      ELSE '  plain text ' || event_id END AS line FROM sec)"""
)


def raw_lines(spark, sf_dir):
    e, c = F.col("event_id"), F.concat
    s = lambda x: F.col(x).cast("string")
    ts = F.floor("ts").cast("long").cast("string")
    json = c(F.lit('{"ts": '), ts, F.lit(', "hostname": "'), "host", F.lit('", "process": {"name": "'), "process", F.lit('", "pid": '), s("pid"), F.lit('}, "destination": {"ip": "'), "dst_ip", F.lit('", "port": "'), s("dst_port"), F.lit('"}, "cmd": "ls", "event.action": "'), "action", F.lit('"}'))
    syslog = c(F.lit("<"), (e % 100).cast("string"), F.lit(">Jan "), (1 + e % 28).cast("string"), F.lit(" 0"), (e % 10).cast("string"), F.lit(":15:30 "), "host", F.lit(" sshd["), s("pid"), F.lit("]: "), F.coalesce("message", F.lit("ok")))
    auditd = c(F.lit("type="), F.when(F.col("pid") % 2 == 0, "SYSCALL").otherwise("USER_LOGIN"), F.lit(" msg=audit("), ts, F.lit(".5:"), s("event_id"), F.lit("): pid="), s("pid"), F.lit(' uid="'), "user", F.lit('" comm="'), "process", F.lit('" op='), "action", F.lit(" pid="), (F.col("pid") + 1).cast("string"))
    cef = c(F.lit("CEF:0|acme|fw|1.0|"), s("dst_port"), F.lit("|"), "action", F.lit("|5|src=1.2.3.4 dst="), "dst_ip", F.lit(" dpt="), s("dst_port"), F.lit(' suser="'), "user", F.lit('" rt='), (F.floor("ts").cast("long") * 1000).cast("string"))
    line = F.when(e % 5 == 0, json).when(e % 5 == 1, syslog).when(e % 5 == 2, auditd).when(e % 5 == 3, cef).otherwise(c(F.lit("  plain text "), s("event_id")))
    return security_events(spark, sf_dir).select("event_id", line.alias("line"))


@query("p01_detect_format", f"WITH {LINES_SQL} SELECT event_id, ['json', 'syslog', 'auditd', 'cef', 'unknown'][1 + event_id % 5] AS format FROM lines")
def detect_format(spark, sf_dir):
    return raw_lines(spark, sf_dir).select("event_id", parsing.detect_format(F.col("line")).alias("format"))


_COLS = ("timestamp", "event_type", "host", "user", "process", "pid", "command_line", "src_ip", "dst_ip", "dst_port", "action", "message", "severity", "source")


@query(
    "p08_parse_lines",
    f"""WITH {LINES_SQL} SELECT event_id,
      CASE event_id % 5 WHEN 0 THEN floor(ts) WHEN 1 THEN epoch(make_timestamp(2024, 1, CAST(1 + event_id % 28 AS BIGINT), event_id % 10, 15, 30)) WHEN 2 THEN floor(ts) + 0.5 WHEN 3 THEN floor(ts) END AS "timestamp",
      CASE event_id % 5 WHEN 0 THEN CASE WHEN true THEN 'process' END WHEN 1 THEN 'audit' WHEN 2 THEN CASE WHEN pid % 2 = 0 THEN 'syscall' ELSE 'audit' END WHEN 3 THEN 'network' ELSE 'unknown' END AS event_type,
      CASE WHEN event_id % 5 IN (0, 1) THEN host END AS host, CASE WHEN event_id % 5 IN (2, 3) THEN "user" END AS "user", CASE event_id % 5 WHEN 0 THEN process WHEN 1 THEN 'sshd' WHEN 2 THEN process END AS process,
      CASE event_id % 5 WHEN 0 THEN pid WHEN 1 THEN pid WHEN 2 THEN pid + 1 END AS pid, CASE WHEN event_id % 5 = 0 THEN 'ls' END AS command_line, CASE WHEN event_id % 5 = 3 THEN '1.2.3.4' END AS src_ip,
      CASE WHEN event_id % 5 IN (0, 3) THEN dst_ip END AS dst_ip, CASE WHEN event_id % 5 IN (0, 3) THEN dst_port END AS dst_port, CASE WHEN event_id % 5 IN (0, 2, 3) THEN action END AS action,
      CASE event_id % 5 WHEN 1 THEN coalesce(message, 'ok') WHEN 3 THEN action WHEN 4 THEN 'plain text ' || event_id END AS message, CASE WHEN event_id % 5 = 3 THEN '5' END AS severity,
      ['json', 'syslog', 'auditd', 'cef:acme:fw', 'raw'][1 + event_id % 5] AS source FROM sec""",
)
def parse_lines(spark, sf_dir):
    # parsing costs far more than reading, so the lines of a large row group go to many tasks
    return parsing.parse_lines(raw_lines(spark, sf_dir).repartition("event_id"), year=2024).select("event_id", *(f"event.{c}" for c in _COLS))


@query(
    "p07_extract_kv",
    f"""WITH {LINES_SQL} SELECT event_id, CASE WHEN a THEN CAST(pid + 1 AS VARCHAR) END AS pid, CASE WHEN a THEN "user" END AS uid, CASE WHEN a THEN process END AS comm, CASE WHEN a THEN action END AS op FROM (SELECT *, event_id % 5 = 2 AS a FROM sec)""",
)
def extract_kv(spark, sf_dir):
    kv = parsing.extract_kv(F.col("line"))
    return raw_lines(spark, sf_dir).select("event_id", *(F.try_element_at(kv, F.lit(k)).alias(k) for k in ("pid", "uid", "comm", "op")))


@query(
    "p09_normalize_events",
    f"""WITH {SEC_SQL} SELECT event_id, lower(host) AS host, process, CASE action WHEN 'write' THEN 'exec' ELSE 'login' END AS action, CASE WHEN dst_port % 3 = 0 THEN 'tcp' WHEN dst_port % 3 = 1 THEN 'udp' ELSE 'other' END AS protocol,
      CASE WHEN dst_port % 12 <= 2 THEN 'low' WHEN dst_port % 12 <= 5 THEN 'medium' WHEN dst_port % 12 <= 7 THEN 'high' WHEN dst_port % 12 = 11 THEN 'weird' ELSE 'critical' END AS severity FROM sec""",
)
def normalize_events(spark, sf_dir):
    k = F.col("dst_port")
    dirty = security_events(spark, sf_dir).select(
        "event_id", F.upper("host").alias("host"), F.when(k % 2 == 0, F.concat(F.lit("C:\\Windows\\"), "process")).otherwise(F.concat(F.lit("/usr/bin/"), "process")).alias("process"),
        F.when(F.col("action") == "write", "EXECVE").otherwise("Logon").alias("action"), F.when(k % 3 == 0, "6").when(k % 3 == 1, "17").otherwise("Other").alias("protocol"),
        F.when(k % 12 == 11, F.lit("Weird")).otherwise((k % 12).cast("string")).alias("severity"),
    )
    return parsing.normalize_events(dirty)


@query(
    "p10_parse_timestamp",
    f"""WITH {SEC_SQL} SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE floor(ts) END AS parsed FROM sec""",
)
def parse_timestamp(spark, sf_dir):
    s = F.floor("ts").cast("long")
    when = F.timestamp_seconds(s)
    n = F.col("event_id") % 7
    text = (
        F.when(n == 0, s.cast("string")).when(n == 1, (s * 1000).cast("string")).when(n == 2, (s * 1000000).cast("string")).when(n == 3, (s * 1000000000).cast("string"))
        .when(n == 4, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 5, F.date_format(when, "MMM d HH:mm:ss")).otherwise("not a time")
    )
    return security_events(spark, sf_dir).select("event_id", parsing.parse_timestamp(text, 2024).alias("parsed"))


@query("p11_format_iso", f"WITH {SEC_SQL} SELECT event_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM sec")
def format_iso(spark, sf_dir):
    return security_events(spark, sf_dir).select("event_id", parsing.format_iso(F.floor(F.col("ts") * 1000) / 1000).alias("iso"))


@query("p15_severity_from_score", f"WITH {DET_SQL} SELECT event_id, severity FROM det")
def severity(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", severity_from_score(F.col("score")).alias("severity"))


#: Indicators: what pages and events look like, in several spellings.
_CAND = """(SELECT page_id AS id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '://([^/?#]*)', 1) WHEN 2 THEN md5(url) WHEN 3 THEN upper(sha1(url)) WHEN 4 THEN 'a' || page_id || '@Example.com'
    WHEN 5 THEN '10.0.' || (page_id % 7) || '.' || (page_id % 100) || ':80' WHEN 6 THEN 'HKLM\\Run\\' || page_id ELSE 'no indicator' END AS value FROM pages)"""


def candidates(spark, sf_dir):
    p = F.col("page_id")
    s = p.cast("string")
    value = (
        F.when(p % 8 == 0, F.col("url")).when(p % 8 == 1, F.regexp_extract("url", "://([^/?#]*)", 1)).when(p % 8 == 2, F.md5("url")).when(p % 8 == 3, F.upper(F.sha1("url")))
        .when(p % 8 == 4, F.concat(F.lit("a"), s, F.lit("@Example.com"))).when(p % 8 == 5, F.concat(F.lit("10.0."), (p % 7).cast("string"), F.lit("."), (p % 100).cast("string"), F.lit(":80")))
        .when(p % 8 == 6, F.concat(F.lit("HKLM\\Run\\"), s)).otherwise("no indicator")
    )
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(p.alias("id"), value.alias("value"))


@query("p12_infer_ioc_type", f"SELECT id, ['url', 'domain', 'hash_md5', 'hash_sha1', 'email', 'ip', 'registry', NULL][1 + id % 8] AS type FROM {_CAND}")
def infer_ioc_type(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", parsing.infer_ioc_type(F.col("value")).alias("type"))


_NORM = "CASE WHEN id % 8 IN (2, 3, 4) THEN lower(value) WHEN id % 8 = 1 THEN regexp_replace(lower(value), '^www\\.', '') WHEN id % 8 = 5 THEN split_part(value, ':', 1) ELSE value END"


@query("p13_p14_normalize_ioc", f"SELECT id, {_NORM} AS value, substr(sha1(['url', 'domain', 'hash_md5', 'hash_sha1', 'email', 'ip', 'registry'][1 + id % 8] || '|' || {_NORM}), 1, 16) AS fingerprint FROM {_CAND}")
def normalize_ioc(spark, sf_dir):
    kind = parsing.infer_ioc_type(F.col("value"))
    value = parsing.normalize_ioc(kind, F.col("value"))
    return candidates(spark, sf_dir).select("id", value.alias("value"), F.when(kind.isNotNull(), parsing.ioc_fingerprint(kind, value)).alias("fingerprint"))


#: A feed over parts: addresses, processes, files and domains, each from two sources.
_FEED = """feed AS (SELECT p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'process' WHEN 2 THEN 'file_path' ELSE 'domain' END AS type,
    CASE p_partkey % 4 WHEN 0 THEN '10.0.' || (p_partkey % 7) || '.' || (p_partkey % 100) WHEN 1 THEN 'p' || (p_partkey % 3) WHEN 2 THEN '/data/f' || (p_partkey % 90) || '.txt' ELSE 'evil' || (p_partkey % 60) || '.example.com' END AS value,
    CASE WHEN p_partkey % 3 = 0 THEN 'feedA' ELSE 'feedB' END AS source, 0.5 + (p_partkey % 5) / 10.0::DOUBLE AS confidence, 0.6 + (p_partkey % 4) / 10.0::DOUBLE AS threat_score, ['t' || (p_partkey % 3)] AS tags,
    CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_partkey ELSE '' END AS description FROM part)"""
_MERGED = (
    _FEED
    + """, ioc AS (SELECT type, value, max(confidence) AS confidence, max(threat_score) AS threat_score, list_sort(list_distinct(flatten(list(tags)))) AS tags, first(source ORDER BY confidence DESC, seq) AS source,
    coalesce(first(description ORDER BY seq) FILTER (description <> ''), '') AS description FROM feed GROUP BY 1, 2)"""
)


def feed(spark, sf_dir):
    p = F.col("p_partkey")
    s = lambda x: x.cast("string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        p.alias("seq"),
        F.when(p % 4 == 0, "ip").when(p % 4 == 1, "process").when(p % 4 == 2, "file_path").otherwise("domain").alias("type"),
        F.when(p % 4 == 0, F.concat(F.lit("10.0."), s(p % 7), F.lit("."), s(p % 100))).when(p % 4 == 1, F.concat(F.lit("p"), s(p % 3))).when(p % 4 == 2, F.concat(F.lit("/data/f"), s(p % 90), F.lit(".txt"))).otherwise(F.concat(F.lit("evil"), s(p % 60), F.lit(".example.com"))).alias("value"),
        F.when(p % 3 == 0, "feedA").otherwise("feedB").alias("source"),
        (0.5 + (p % 5) / 10.0).alias("confidence"),
        (0.6 + (p % 4) / 10.0).alias("threat_score"),
        F.array(F.concat(F.lit("t"), s(p % 3))).alias("tags"),
        F.when(p % 2 == 0, F.concat(F.lit("d"), s(p))).otherwise("").alias("description"),
    )


@query("a10_merge_iocs", f"WITH {_MERGED} SELECT type, value, round(confidence, 9) AS confidence, round(threat_score, 9) AS threat_score, array_to_string(tags, ',') AS tags, source, description FROM ioc")
def merge_iocs(spark, sf_dir):
    return intel.merge_iocs(feed(spark, sf_dir)).select("type", "value", F.round("confidence", 9).alias("confidence"), F.round("threat_score", 9).alias("threat_score"), F.array_join("tags", ",").alias("tags"), "source", "description")


@query(
    "a11_ioc_stats",
    f"WITH {_MERGED} SELECT 'type' AS dimension, type AS value, count(*) AS count FROM ioc GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM ioc GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM ioc",
)
def ioc_stats(spark, sf_dir):
    from ..operators.store import counts_by_each

    return counts_by_each(intel.merge_iocs(feed(spark, sf_dir)), "type", "source")


_MATCH = (
    SEC_SQL
    + ", "
    + _MERGED
    + """, seen AS (SELECT event_id, unnest([{'field': 'dst_ip', 'type': 'ip', 'value': dst_ip}, {'field': 'file_path', 'type': 'file_path', 'value': file_path}, {'field': 'process', 'type': 'process', 'value': process}, {'field': 'user', 'type': 'user', 'value': "user"},
      {'field': 'command_line', 'type': 'domain', 'value': nullif(regexp_extract(command_line, 'https?://([^/ ]+)', 1), '')}]) AS o FROM sec),
    m AS (SELECT event_id, o.field AS field, o.type AS type, o.value AS value, confidence, threat_score, source FROM seen JOIN ioc ON ioc.type = o.type AND ioc.value = o.value)"""
)


@query("j05_j08_match_iocs", f"WITH {_MATCH} SELECT event_id, field, type, value, source FROM m")
def match_iocs(spark, sf_dir):
    return intel.match_iocs(security_events(spark, sf_dir), intel.merge_iocs(feed(spark, sf_dir))).select("event_id", "field", "type", "value", "source")


@query(
    "a03_score_ioc_matches",
    f"""WITH {_MATCH}, r AS (SELECT event_id, threat_score * confidence AS w, row_number() OVER (PARTITION BY event_id ORDER BY threat_score * confidence DESC) - 1 AS i FROM m),
    s AS (SELECT event_id, least(1.0, max(w) + 0.25 * sum(CASE WHEN i = 0 THEN 0 ELSE w * pow(0.6, i) END)) AS score, count(*) AS matches FROM r GROUP BY 1) SELECT event_id, round(score, 9) AS score, matches FROM s WHERE score >= 0.5""",
)
def score_ioc_matches(spark, sf_dir):
    m = intel.match_iocs(security_events(spark, sf_dir), intel.merge_iocs(feed(spark, sf_dir)))
    return intel.score_ioc_matches(m).select("event_id", F.round("score", 9).alias("score"), F.col("matches").cast("long").alias("matches"))


@query(
    "j09_enrich_events",
    f"""WITH {_MATCH}, h AS (SELECT event_id, string_agg(field || '=' || value, ',' ORDER BY field, value) AS hits FROM m GROUP BY 1) SELECT event_id, coalesce(hits, '') AS hits FROM sec LEFT JOIN h USING (event_id)""",
)
def enrich_events(spark, sf_dir):
    rich = intel.enrich_events(security_events(spark, sf_dir), intel.merge_iocs(feed(spark, sf_dir)))
    text = F.array_join(F.transform("ioc_hits", lambda h: F.concat_ws("=", h["field"], h["value"])), ",")
    return rich.select("event_id", F.coalesce(text, F.lit("")).alias("hits"))


@query(
    "j10_reputation_join",
    f"""WITH {SEC_SQL}, rep AS (SELECT '10.0.' || (s_suppkey % 7) || '.' || s_suppkey AS value, s_suppkey / 100.0::DOUBLE AS score, 1704067200 + s_suppkey * 20000.0 AS cached_at FROM supplier)
    SELECT event_id, 'dst_ip' AS field, rep.value AS value, score FROM sec JOIN rep ON rep.value = dst_ip WHERE ts >= cached_at AND ts - cached_at <= 604800""",
)
def reputation_join(spark, sf_dir):
    k = F.col("s_suppkey")
    rep = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.lit("ip").alias("kind"), F.concat(F.lit("10.0."), (k % 7).cast("string"), F.lit("."), k.cast("string")).alias("value"), (k / 100.0).alias("score"), (1704067200 + k * 20000.0).alias("cached_at")
    )
    return intel.reputation_join(security_events(spark, sf_dir), rep, 604800.0)

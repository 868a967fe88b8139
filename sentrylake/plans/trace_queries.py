"""Provenance traces over line items: suppliers act on parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import stored
from ..operators import attribution, influence, ml, representatives, traces
from ..sources.standins import SEC_SQL, security_events, table
from .registry import query

TRACE_SQL = """tr AS (SELECT l_orderkey * 8 + l_linenumber AS seq, 's' || l_suppkey AS "actorID", 'p' || l_partkey AS "objectID", l_returnflag AS action, l_suppkey AS sk, l_partkey AS pk,
    CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE n_name END AS exec, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE '/p/' || l_partkey END AS path, l_quantity AS quantity
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def trace(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), s("s", "l_suppkey").alias("actorID"), s("p", "l_partkey").alias("objectID"), F.col("l_returnflag").alias("action"),
        F.when(F.col("l_suppkey") % 6 == 0, "").otherwise(F.col("n_name")).alias("exec"), F.when(F.col("l_partkey") % 5 == 0, F.lit(None)).otherwise(s("/p/", "l_partkey")).alias("path"),
        F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("pk"), F.col("l_quantity").alias("quantity"),
    )


@query(
    "j01_stitch_types",
    f"""WITH {TRACE_SQL} SELECT actor_type, object, count(*) AS rows FROM (SELECT CASE WHEN sk % 2 = 0 THEN 'SUBJECT_THREAD' ELSE 'SUBJECT_PROCESS' END AS actor_type, CASE WHEN pk % 3 = 0 THEN 'NetFlowObject' ELSE 'FILE_OBJECT_FILE' END AS object FROM tr WHERE pk % 4 <> 1) GROUP BY 1, 2""",
)
def stitch_types(spark, sf_dir):
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    p, k = F.col("p_partkey"), F.col("s_suppkey")
    files = parts.where(p % 4 != 1).select(F.concat(F.lit("p"), p.cast("string")).alias("id"), F.lit("FILE_OBJECT_FILE").alias("type"))
    flows = parts.where((p % 3 == 0) & (p % 4 != 1)).select(F.concat(F.lit("p"), p.cast("string")).alias("id"), F.lit("NetFlowObject").alias("type"))
    subjects = suppliers.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "SUBJECT_THREAD").otherwise("SUBJECT_PROCESS").alias("type"))
    return traces.stitch_types(trace(spark, sf_dir), files, flows, subjects).groupBy("actor_type", "object").agg(F.count("*").alias("rows"))


@query(
    "j02_attach_netflow",
    f"""WITH {TRACE_SQL} SELECT seq, CASE WHEN pk % 3 = 0 THEN '10.1.0.' || (pk % 250) || ':' || (pk % 1000) ELSE coalesce(path, '') END AS target FROM tr""",
)
def attach_netflow(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumn("object", F.when(F.col("pk") % 3 == 0, "NetFlowObject").otherwise("FILE_OBJECT_FILE")).withColumn("properties", F.create_map(F.lit("objectpath"), F.col("path")))
    p = F.col("p_partkey")
    flows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), p.cast("string")).alias("id"), F.lit("127.0.0.1").alias("local_address"), F.lit(1).alias("local_port"), F.concat(F.lit("10.1.0."), (p % 250).cast("string")).alias("remote_address"), (p % 1000).alias("remote_port")
    )
    out = traces.attach_netflow(rows, flows)
    address = F.concat_ws(":", F.try_element_at("properties", F.lit("remoteAddress")), F.try_element_at("properties", F.lit("remotePort")))
    return out.select("seq", F.when(F.col("object") == "NetFlowObject", address).otherwise(F.coalesce(F.try_element_at("properties", F.lit("objectpath")), F.lit(""))).alias("target"))


@query(
    "j03_fill_missing_paths",
    f"""WITH {TRACE_SQL}, q AS (SELECT seq, 'n' || (pk % 100 + 1) AS "objectID", pk % 5 = 0 AS empty, path FROM tr), f AS (SELECT 'n' || sk AS "objectID", min_by(exec, seq) AS first_exec FROM tr WHERE exec <> '' GROUP BY 1)
    SELECT seq, coalesce(path, first_exec) AS path FROM q LEFT JOIN f USING ("objectID")""",
)
def fill_missing_paths(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumn("actorID", F.concat(F.lit("n"), F.col("sk").cast("string"))).withColumn("objectID", F.concat(F.lit("n"), (F.col("pk") % 100 + 1).cast("string")))
    rows = rows.withColumn("object", F.lit("SUBJECT_PROCESS")).withColumn("properties", F.when(F.col("path").isNotNull(), F.create_map(F.lit("objectpath"), "path")))
    return traces.fill_missing_paths(rows).select("seq", F.try_element_at("properties", F.lit("objectpath")).alias("path"))


@query(
    "j04_add_attributes",
    f"""WITH {TRACE_SQL} SELECT DISTINCT "actorID", "objectID", action, CAST(seq AS VARCHAR) AS "timestamp", exec FROM tr""",
)
def add_attributes(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumnRenamed("seq", "timestamp")
    edges = rows.select("actorID", "objectID", "action", "timestamp")
    return traces.add_attributes(edges, rows.select("actorID", "objectID", "action", "timestamp", "exec"))


@query(
    "p22_dedup_trace_events",
    f"""WITH {TRACE_SQL} SELECT "actorID", "objectID", action, max(seq) AS seq FROM tr WHERE action <> 'N' AND sk % 7 <> pk % 7 GROUP BY ALL""",
)
def dedup_trace_events(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumn("action", F.when(F.col("action") == "N", "START").otherwise(F.col("action"))).withColumn("object", F.when(F.col("sk") % 7 == F.col("pk") % 7, "REGISTRY").otherwise("FILE"))
    rows = rows.withColumn("pid", F.lit(1)).withColumn("ppid", F.lit(0))
    return traces.dedup_trace_events(rows).select("actorID", "objectID", "action", "seq")


def with_properties(spark, sf_dir):
    k = F.col("pk") % 4
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    obj = F.when(k == 0, "PROCESS").when(k == 1, "FILE").when(k == 2, "FLOW").otherwise("MODULE")
    props = F.when(k == 0, F.create_map(F.lit("parent_image_path"), F.col("exec"), F.lit("image_path"), s("i", "sk"), F.lit("command_line"), s("c", "pk")))
    props = props.when(k == 1, F.create_map(F.lit("image_path"), s("i", "sk"), F.lit("file_path"), F.col("path")))
    props = props.when(k == 2, F.create_map(F.lit("image_path"), s("i", "sk"), F.lit("dest_ip"), s("d", "pk"), F.lit("dest_port"), F.lit("80"))).otherwise(F.create_map(F.lit("image_path"), s("i", "sk"), F.lit("module_path"), s("m", "pk")))
    return trace(spark, sf_dir).withColumn("object", obj).withColumn("properties", props)


@query(
    "p19_actor_object_names",
    f"""WITH {TRACE_SQL} SELECT seq, CASE WHEN pk % 4 = 0 THEN exec ELSE 'i' || sk END AS actorname, CASE pk % 4 WHEN 0 THEN 'i' || sk WHEN 1 THEN path WHEN 2 THEN 'd' || pk || ' 80' ELSE 'm' || pk END AS objectname FROM tr WHERE NOT (pk % 4 = 1 AND path IS NULL)""",
)
def actor_object_names(spark, sf_dir):
    return traces.actor_object_names(with_properties(spark, sf_dir)).select("seq", "actorname", "objectname")


@query(
    "p20_describe_event",
    f"""WITH {TRACE_SQL} SELECT seq, CASE pk % 4 WHEN 0 THEN exec || ' ' || action || ' i' || sk || ' c' || pk WHEN 1 THEN coalesce('i' || sk || ' ' || action || ' ' || path, '') WHEN 2 THEN '' ELSE 'i' || sk || ' ' || action || ' m' || pk END AS phrase FROM tr""",
)
def describe_event(spark, sf_dir):
    return with_properties(spark, sf_dir).select("seq", F.array_join(traces.describe_event(), " ").alias("phrase"))


@query(
    "p21_map_etw_events",
    f"""WITH {SEC_SQL}, k AS (SELECT *, ['TcpIpSendIPV4', 'FileIORead', 'ProcessStart', 'ThreadStart'][1 + event_id % 4] AS kind FROM sec)
    SELECT event_id AS "TimeStamp", kind AS action, CASE kind WHEN 'ProcessStart' THEN CAST(parent_pid AS VARCHAR) ELSE CAST(pid AS VARCHAR) END AS "actorID", CASE kind WHEN 'TcpIpSendIPV4' THEN dst_ip WHEN 'FileIORead' THEN file_path ELSE CAST(pid AS VARCHAR) END AS "objectID",
      CASE kind WHEN 'TcpIpSendIPV4' THEN 'FLOW' WHEN 'FileIORead' THEN 'FILE' ELSE 'PROCESS' END AS object, CASE kind WHEN 'TcpIpSendIPV4' THEN dst_ip WHEN 'FileIORead' THEN file_path ELSE command_line END AS objectname FROM k WHERE kind <> 'ThreadStart'""",
)
def map_etw_events(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("TcpIpSendIPV4", "FileIORead", "ProcessStart", "ThreadStart"))), (F.col("event_id") % 4).cast("int"))
    args = F.create_map(F.lit("daddr"), "dst_ip", F.lit("FileName"), "file_path", F.lit("ProcessId"), F.col("pid").cast("string"), F.lit("ImageFileName"), "command_line")
    rows = security_events(spark, sf_dir).select(kind.alias("Event"), F.col("pid").alias("PID"), F.col("parent_pid").alias("PPID"), F.col("process").alias("PName"), args.alias("args"), F.col("event_id").alias("TimeStamp"))
    return traces.map_etw_events(rows).drop("actorname")


@query("p23_split_train_test", f"WITH {SEC_SQL} SELECT CASE WHEN ts < 1705320000 THEN 'train' ELSE 'test' END AS part, count(*) AS rows FROM sec WHERE event_type IN ('process', 'file') GROUP BY 1")
def split_train_test(spark, sf_dir):
    rows = security_events(spark, sf_dir).where(F.col("event_type").isin("process", "file"))
    return rows.groupBy(F.when(F.col("ts") < 1705320000, "train").otherwise("test").alias("part")).agg(F.count("*").alias("rows"))


@query("p24_canonical_properties", f"""WITH {TRACE_SQL} SELECT seq, '{{"a":"' || action || '","path":"' || pk || '","z":"' || exec || '"}}' AS json FROM tr""")
def canonical_properties(spark, sf_dir):
    props = F.create_map(F.lit("z"), "exec", F.lit("path"), F.col("pk").cast("string"), F.lit("a"), "action")
    return trace(spark, sf_dir).select("seq", traces.canonical_properties(props).alias("json"))


@query("p25_second_object_rows", f"""WITH {TRACE_SQL} SELECT seq, "objectID" FROM tr UNION ALL SELECT seq, path FROM tr WHERE path IS NOT NULL""")
def second_object_rows(spark, sf_dir):
    return traces.second_object_rows(trace(spark, sf_dir).select("seq", "objectID", F.col("path").alias("objectID2")))


@query(
    "a29_missing_semantics",
    f"""WITH {TRACE_SQL}, u AS (SELECT 'actor' AS side, CASE WHEN sk % 2 = 0 THEN 'A' ELSE 'B' END AS type, exec = '' AS m FROM tr UNION ALL SELECT 'object', CASE WHEN pk % 3 = 0 THEN 'X' ELSE 'Y' END, path IS NULL FROM tr)
    SELECT side, type, count(*) FILTER (m) AS missing, count(*) AS total, round(100 * count(*) FILTER (m) / count(*), 2) AS percent FROM u GROUP BY 1, 2""",
)
def missing_semantics(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumn("actor_type", F.when(F.col("sk") % 2 == 0, "A").otherwise("B")).withColumn("object", F.when(F.col("pk") % 3 == 0, "X").otherwise("Y"))
    return traces.missing_semantics(rows.withColumn("properties", F.when(F.col("path").isNotNull(), F.create_map(F.lit("p"), "path"))))


@query(
    "g17_node_documents",
    f"""WITH {TRACE_SQL}, e AS (SELECT "actorID" AS node, seq, exec, action, path, exec AS name FROM tr UNION ALL SELECT "objectID", seq, exec, action, path, path FROM tr)
    SELECT node, md5(string_agg(concat_ws(' ', exec, action, path), ' ' ORDER BY seq, exec, action, path NULLS FIRST)) AS document, last(coalesce(name, '-') ORDER BY seq, name NULLS FIRST) AS name FROM e GROUP BY 1""",
)
def node_documents(spark, sf_dir):
    docs = traces.node_documents(trace(spark, sf_dir))
    return docs.select("node", F.md5(F.array_join("tokens", " ")).alias("document"), F.coalesce("name", F.lit("-")).alias("name"))


@query("g18_neighbor_names", f"""WITH {TRACE_SQL}, e AS (SELECT "actorID" AS node, path AS name FROM tr UNION ALL SELECT "objectID", exec FROM tr) SELECT node, count(DISTINCT name) AS names FROM e GROUP BY 1""")
def neighbor_names(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumn("objectname", F.col("path")).withColumn("actorname", F.col("exec"))
    return traces.neighbor_names(rows).select("node", F.size("names").cast("long").alias("names"))


@query(
    "j13_reduce_evaluation_graph",
    f"""WITH {TRACE_SQL} SELECT DISTINCT exec, path FROM tr WHERE action = 'R' AND exec = (SELECT min(exec) FROM tr WHERE exec <> '') AND path NOT IN (SELECT path FROM tr WHERE action <> 'R' AND exec = (SELECT max(exec) FROM tr) AND path IS NOT NULL) AND path IS NOT NULL""",
)
def reduce_evaluation_graph(spark, sf_dir):
    rows = trace(spark, sf_dir).where("path is not null")
    low, high = rows.where("exec <> ''").agg(F.min("exec"), F.max("exec")).first()
    return traces.reduce_evaluation_graph(rows.where("action = 'R'"), rows.where("action <> 'R'"), low, high)


#: Scores of test entities (nations) with a supplier left out; none left out is zeroth.
SCORE_SQL = (
    TRACE_SQL
    + """, m AS (SELECT CASE WHEN sk % 20 = 0 THEN 'zeroth' ELSE 's' || sk END AS omitted, exec AS entity, round(avg(quantity), 6) AS score FROM tr WHERE exec <> '' AND (sk < 40 OR sk % 20 = 0) GROUP BY 1, 2),
    c AS (SELECT 'e' || (sk % 10) AS entity, 'zeroth' AS omitted, round(sum(quantity), 6) AS score FROM tr GROUP BY 1, 2 UNION ALL SELECT 'e' || (sk % 10), 'p' || (pk % 15), round(sum(quantity) * 15, 6) FROM tr GROUP BY 1, 2)"""
)


def score_matrix(spark, sf_dir):
    entity = F.concat(F.lit("e"), (F.col("sk") % 10).cast("string")).alias("entity")
    rows = trace(spark, sf_dir)
    base = rows.groupBy(entity).agg(F.round(F.sum("quantity"), 6).alias("score")).select("entity", F.lit("zeroth").alias("omitted"), "score")
    return base.unionByName(rows.groupBy(entity, F.concat(F.lit("p"), (F.col("pk") % 15).cast("string")).alias("omitted")).agg(F.round(F.sum("quantity") * 15, 6).alias("score")))


@query(
    "w21_top_k_contributors",
    f"""WITH {SCORE_SQL} SELECT entity, omitted, score - (SELECT score FROM c z WHERE z.entity = c.entity AND z.omitted = 'zeroth') AS diff FROM c WHERE omitted <> 'zeroth'
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY diff DESC, omitted) <= 3""",
)
def top_k_contributors(spark, sf_dir):
    return traces.top_k_contributors(score_matrix(spark, sf_dir))


@query(
    "w22_confidence",
    f"""WITH {SEC_SQL}, s AS (SELECT event_id, list_reverse_sort([value, dst_port + 1.0::DOUBLE, pid + 0.5::DOUBLE]) AS p FROM sec), c AS (SELECT event_id AS id, (p[1] - p[2]) / p[1] AS c FROM s)
    SELECT id, round((c - (SELECT min(c) FROM c)) / (SELECT max(c) FROM c), 9) AS confidence FROM c""",
)
def confidence(spark, sf_dir):
    p = F.array("value", F.col("dst_port") + 1.0, F.col("pid") + 0.5)
    return traces.confidence(security_events(spark, sf_dir).select(F.col("event_id").alias("id"), p.alias("probabilities"))).select("id", F.round("confidence", 9).alias("confidence"))


@query("w23_balanced_shards")
def balanced_shards(spark, sf_dir):
    return traces.balanced_shards(trace(spark, sf_dir), "actorID", 8)


@query("w24_category_split", "SELECT s_suppkey AS id, ntile(7) OVER (ORDER BY s_suppkey) AS \"group\" FROM supplier")
def category_split(spark, sf_dir):
    return traces.category_split(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), 7)


@query(
    "a38_attribution_overlap",
    f"""WITH {TRACE_SQL}, a AS (SELECT exec AS entity, list(DISTINCT pk) AS x FROM tr WHERE action = 'R' GROUP BY 1), b AS (SELECT exec AS entity, list(DISTINCT pk) AS y FROM tr WHERE action <> 'R' GROUP BY 1)
    SELECT round(avg(len(list_intersect(x, y)) / len(x)), 9) AS mean, count(*) FILTER (len(list_intersect(x, y)) / len(x) > 0.8) AS above FROM a JOIN b USING (entity)""",
)
def attribution_overlap(spark, sf_dir):
    rows = trace(spark, sf_dir).select(F.col("exec").alias("entity"), F.col("pk").alias("omitted"), "action")
    return traces.attribution_overlap(rows.where("action = 'R'"), rows.where("action <> 'R'")).withColumn("mean", F.round("mean", 9))


NUMBERS = ["dst_port", "bytes_sent", "pid", "value"]


@query("m01_event_features")
def event_features(spark, sf_dir):
    return ml.event_features(security_events(spark, sf_dir))


@query("m02_m03_isolation_forest")
def isolation_forest(spark, sf_dir):
    rows = ml.dense_numeric(security_events(spark, sf_dir), NUMBERS)
    return ml.score_isolation_forest(rows, ml.fit_isolation_forest(rows, trees=32, sample=128))


@query("m03_flag_anomalies")
def flag_anomalies(spark, sf_dir):
    return ml.flag_anomalies(isolation_forest(spark, sf_dir), 0.02)


@query(
    "a40_build_vocab",
    """WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM conversations), c AS (SELECT word, count(*) AS count FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 498)
    SELECT word, row_number() OVER (ORDER BY count DESC, word) + 1 AS id, count FROM c""",
)
def build_vocab(spark, sf_dir):
    return ml.build_vocab(table(spark, sf_dir, "conversations"), 500)


@query(
    "m14_encode_tokens",
    """WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1:16] AS ws FROM benchmark), u AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM b),
    c AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 1 AS id FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM benchmark) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 98),
    t AS (SELECT item_id, list(coalesce(id, 1) ORDER BY p) AS ids FROM u LEFT JOIN c USING (word) GROUP BY 1) SELECT item_id, array_to_string((coalesce(ids, []) || [0 FOR i IN range(16)])[1:16], ' ') AS ids FROM benchmark LEFT JOIN t USING (item_id)""",
)
def encode_tokens(spark, sf_dir):
    texts = table(spark, sf_dir, "benchmark")
    out = ml.encode_tokens(texts, ml.build_vocab(texts, 100), 16, "item_id")
    return out.select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(
    "m15_pool_embeddings",
    """WITH e AS (SELECT vec_id, [embedding[i * 8 + 1 : i * 8 + 8] FOR i IN range(8)] AS v FROM embeddings), u AS (SELECT vec_id, generate_subscripts(v, 1) AS t, unnest(v) AS x FROM e), y AS (SELECT vec_id, t, generate_subscripts(x, 1) AS d, unnest(x)::DOUBLE AS x FROM u WHERE t <= 1 + vec_id % 8),
    m AS (SELECT vec_id, d, avg(x) AS mean, max(x) AS mx FROM y GROUP BY 1, 2) SELECT vec_id, round(sum(mean * d), 5) AS mean, round(sum(mx * d), 5) AS max FROM m GROUP BY 1""",
)
def pool_embeddings(spark, sf_dir):
    vectors = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int"))
    weigh = lambda v: F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.alias("v"), mask.alias("m"))
    return rows.select("vec_id", weigh(ml.pool_embeddings(F.col("v"), F.col("m"), "mean")).alias("mean"), weigh(ml.pool_embeddings(F.col("v"), F.col("m"), "max")).alias("max"))


@query(
    "a39_average_parameters",
    """WITH u AS (SELECT label AS category, 'n' || (vec_id % 3) AS name, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings) SELECT category, name, position, round(avg(v), 7) AS value FROM u GROUP BY 1, 2, 3""",
)
def average_parameters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("category"), F.concat(F.lit("n"), (F.col("vec_id") % 3).cast("string")).alias("name"), F.col("embedding").cast("array<double>").alias("values"))
    return ml.average_parameters(rows).withColumn("value", F.round("value", 7))


@query(
    "m07_neighbor_mean_features",
    """WITH v AS (SELECT s_suppkey, s_acctbal AS a, s_nationkey::DOUBLE AS b FROM supplier), e AS (SELECT DISTINCT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON b.s_suppkey % 10 = a.s_suppkey % 10 AND b.s_suppkey = a.s_suppkey + 10),
    u AS (SELECT x, y FROM e UNION SELECT y, x FROM e), m AS (SELECT x, avg(a) AS ma, avg(b) AS mb FROM u JOIN v ON s_suppkey = y GROUP BY 1) SELECT s_suppkey AS node, round(coalesce(ma, 0), 6) AS mean_a, round(coalesce(mb, 0), 6) AS mean_b FROM v LEFT JOIN m ON x = s_suppkey""",
)
def neighbor_mean_features(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("x"))
    edges = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 10).alias("dst")).join(s.select(F.col("s_suppkey").alias("dst")), "dst", "left_semi")
    out = ml.neighbor_means(nodes, edges)
    return out.select("node", F.round(F.get("mean", F.lit(0)), 6).alias("mean_a"), F.round(F.get("mean", F.lit(1)), 6).alias("mean_b"))


@query("m07_neighbor_features", """WITH v AS (SELECT s_suppkey AS k, s_acctbal AS a FROM supplier), u AS (SELECT a.k AS x, b.k AS y FROM v a JOIN v b ON b.k = a.k + 10 UNION SELECT b.k, a.k FROM v a JOIN v b ON b.k = a.k + 10),
    m AS (SELECT k, v.a, coalesce((SELECT avg(w.a) FROM u JOIN v w ON w.k = u.y WHERE u.x = v.k), 0) AS b FROM v)
    SELECT k AS node, round(a, 6) AS x0, round(b, 6) AS x1, round(coalesce((SELECT avg(n.a) FROM u JOIN m n ON n.k = u.y WHERE u.x = m.k), 0), 6) AS x2, round(coalesce((SELECT avg(n.b) FROM u JOIN m n ON n.k = u.y WHERE u.x = m.k), 0), 6) AS x3 FROM m""")
def neighbor_features(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), F.array(F.col("s_acctbal").cast("double")).alias("x"))
    edges = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 10).alias("dst")).join(s.select(F.col("s_suppkey").alias("dst")), "dst", "left_semi")
    return ml.neighbor_features(nodes, edges, 2).select("node", *(F.round(F.get("x", F.lit(i)), 6).alias(f"x{i}") for i in range(4)))


@query("g17_indexed_edges", f"""WITH {TRACE_SQL}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT "actorID" AS node FROM tr UNION SELECT "objectID" FROM tr))
    SELECT DISTINCT a.i AS src, b.i AS dst FROM tr JOIN n a ON a.node = "actorID" JOIN n b ON b.node = "objectID" """)
def indexed_edges(spark, sf_dir):
    return traces.indexed_edges(trace(spark, sf_dir))[1]


@query("g17_class_labels", f"""WITH {TRACE_SQL}, e AS (SELECT seq, "actorID" AS node, exec AS name FROM tr UNION ALL SELECT seq, "objectID", path FROM tr), l AS (SELECT node, max_by(name, (seq, name)) FILTER (name IS NOT NULL) AS name, max(seq) AS s FROM e GROUP BY 1)
    SELECT node, CASE name WHEN 'FRANCE' THEN 0 WHEN 'NATION_1' THEN 1 ELSE 2 END AS label FROM l WHERE node LIKE 's%'""")
def class_labels(spark, sf_dir):
    named = traces.node_labels(trace(spark, sf_dir)).where("node like 's%'")
    return traces.class_labels(named, ["FRANCE", "NATION_1"]).select("node", "label")


@query("m04_reconstruction_error")
def reconstruction_error(spark, sf_dir):
    return ml.reconstruction_error(ml.dense_numeric(security_events(spark, sf_dir), NUMBERS))


@query("m05_m06_embed_documents")
def embed_documents(spark, sf_dir):
    # counted, trained on and embedded: made once
    docs = stored(traces.node_documents(trace(spark, sf_dir)).select("node", "tokens"))
    return ml.embed_documents(docs, ml.fit_token_embeddings(docs, size=8), 8)


@query("g10_prune_shared_periphery")
def prune_shared_periphery(spark, sf_dir):
    from ..operators import graph

    rows = trace(spark, sf_dir)
    edges = rows.select(F.col("actorID").alias("src"), F.col("objectID").alias("dst"), "action")
    return graph.prune_shared_periphery(edges, edges.where("action <> 'R'"), "s3")


def customer_nodes(spark, sf_dir):
    """Customers as nodes of three types with their own features and the means of their neighbours'."""
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.col("c_custkey").alias("node"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("x"))
    edges = c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 10).alias("dst")).join(c.select(F.col("c_custkey").alias("dst")), "dst", "left_semi")
    both = ml.neighbor_means(nodes, edges).select("node", F.concat("x", "mean").alias("x"))
    return both.join(c.select(F.col("c_custkey").alias("node"), (F.length("c_mktsegment") % 3).alias("label")), "node")


@query("m08_m09_node_anomalies")
def node_anomalies(spark, sf_dir):
    nodes = customer_nodes(spark, sf_dir)
    found = attribution.predict_node_types(attribution.fit_node_types(nodes), nodes)
    return attribution.node_anomalies(found, gate=0.01)


@query("m10_staged_refinement")
def staged_refinement(spark, sf_dir):
    return attribution.staged_refinement(customer_nodes(spark, sf_dir), stages=2)


def _attributed(spark, sf_dir):
    """Training rows by actor's program, and objects to be scored, one in fifty of which is asked about."""
    rows = trace(spark, sf_dir)
    label = F.when(F.col("action") == "R", 0).when(F.col("action") == "A", 1).otherwise(2)
    train = rows.select(F.col("exec").alias("entity"), label.alias("label"), F.array("quantity", (F.col("pk") % 100).cast("double")).alias("x"))
    asked = F.when(F.col("seq") % 50 == 0, F.concat(F.lit("e"), (F.col("pk") % 10).cast("string")))
    return train, rows.select(F.col("seq").alias("node"), asked.alias("entity"), F.array("quantity", (F.col("sk") % 100).cast("double")).alias("x"))


@query("m11_leave_one_out_scores")
def leave_one_out(spark, sf_dir):
    return attribution.leave_one_out_scores(*_attributed(spark, sf_dir))


@query("m11_influence_scores")
def influence_scores(spark, sf_dir):
    train, test = _attributed(spark, sf_dir)
    scaled = lambda df: df.withColumn("x", F.transform("x", lambda v: v / 50))
    return influence.influence_scores(scaled(train), scaled(test))


@query("m12_sharded_leave_one_out")
def sharded_leave_one_out(spark, sf_dir):
    return attribution.sharded_leave_one_out(*_attributed(spark, sf_dir), shards=4)


@query("m13_representative_actors")
def representative_actors(spark, sf_dir):
    # an order is an instance of its customer's program, and each of its line items an edge
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("program"))
    edges = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    label = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("string"))
    return representatives.representative_actors(edges, "program", "l_orderkey", label)


@query("m16_batch_embed", "SELECT conv_id * 100 + turn AS id, round(coalesce(list_avg(list_transform(list_filter(regexp_split_to_array(text, ' '), lambda w: w <> ''), lambda w: length(w))), 0), 6) AS x0 FROM conversations")
def batch_embed(spark, sf_dir):
    import numpy as np

    def encoder(texts):
        # an encoder of a user: the length of each word, and a one
        words = [[w for w in t.split(" ") if w] for t in texts]
        most = max(1, *map(len, words))
        mask = np.array([[i < len(w) for i in range(most)] for w in words], dtype=float)
        return np.array([[[len(w[i]), 1.0] if i < len(w) else [0.0, 0.0] for i in range(most)] for w in words]), mask

    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return attribution.batch_embed(texts, encoder, "log").select("id", F.round(F.get("x", F.lit(0)), 6).alias("x0"))

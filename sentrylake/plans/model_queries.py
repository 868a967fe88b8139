"""Ensembles, baselines, metrics and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, quality
from ..sources.standins import DET_SQL, SEC_SQL, detections, security_events
from .registry import query

SCORES_SQL = (
    SEC_SQL
    + """, scores AS (SELECT 'm' || (event_id % 3) AS model_id, CASE WHEN ts < 1705320000 THEN 1 ELSE 2 END AS version, event_id AS seq, least(1.0, value / 120) AS score,
    CASE WHEN dst_port % 7 = 0 THEN NULL WHEN dst_port + value > 90 THEN 1.0 ELSE 0.0 END AS label FROM sec)"""
)


def scores(spark, sf_dir):
    k = F.col("dst_port")
    return security_events(spark, sf_dir).select(
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model_id"), F.when(F.col("ts") < 1705320000, 1).otherwise(2).alias("version"), F.col("event_id").alias("seq"),
        F.least(F.lit(1.0), F.col("value") / 120).alias("score"), F.when(k % 7 == 0, F.lit(None)).when(k + F.col("value") > 90, 1.0).otherwise(0.0).alias("label"),
    )


#: Two or three detectors for each event: the view's own, and two that look at other fields.
HITS_SQL = (
    DET_SQL
    + """, hits AS (SELECT event_id, detector, score, tags FROM det
    UNION ALL SELECT event_id, 'port', dst_port / 100, ['anomaly'] FROM det WHERE dst_port > 40
    UNION ALL SELECT event_id, 'status', 0.75, [status] FROM det WHERE status = 'failure')"""
)


def hits(spark, sf_dir):
    det = detections(spark, sf_dir)
    port = det.where("dst_port > 40").select("event_id", F.lit("port").alias("detector"), (F.col("dst_port") / 100).alias("score"), F.array(F.lit("anomaly")).alias("tags"))
    status = det.where("status = 'failure'").select("event_id", F.lit("status").alias("detector"), F.lit(0.75).alias("score"), F.array("status").alias("tags"))
    return det.select("event_id", "detector", "score", "tags").unionByName(port).unionByName(status)


def _ensemble_sql(score):
    return f"""WITH {HITS_SQL}, e AS (SELECT event_id, {score} AS score, array_to_string(list_sort(list_distinct(list(detector))), ',') AS components,
      array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM hits GROUP BY 1)
    SELECT event_id, round(score, 9) AS score, components, tags, CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.75 THEN 'high' ELSE 'medium' END AS severity FROM e WHERE score >= 0.5"""


def _flat(df):
    return df.select("event_id", F.round("score", 9).alias("score"), F.array_join("components", ",").alias("components"), F.array_join("tags", ",").alias("tags"), "severity")


_W = "CASE detector WHEN 'rule' THEN 2.0 WHEN 'port' THEN 0.5 ELSE 1.0 END"


@query("a02_ensemble_weighted_mean", _ensemble_sql(f"sum({_W} * score) / sum({_W})"))
def ensemble_weighted(spark, sf_dir):
    return _flat(detect.ensemble(hits(spark, sf_dir), weights={"rule": 2.0, "port": 0.5}))


@query("a02_ensemble_max", _ensemble_sql("max(score)"))
def ensemble_max(spark, sf_dir):
    return _flat(detect.ensemble(hits(spark, sf_dir), "max"))


@query("a02_ensemble_majority", _ensemble_sql("CASE WHEN count(*) >= 2 THEN avg(score) ELSE 0 END"))
def ensemble_majority(spark, sf_dir):
    return _flat(detect.ensemble(hits(spark, sf_dir), "majority", detectors=3))


#: Hours stand for minutes: the view has about one event a host and minute at the test scale.
def hourly(spark, sf_dir):
    return security_events(spark, sf_dir).withColumn("ts", F.col("ts") / 60)


HOURLY_SQL = SEC_SQL + ", h AS (SELECT *, CAST(floor(ts / 60 / 60) AS BIGINT) AS minute FROM sec)"


@query(
    "w01_minute_counters",
    f"""WITH {HOURLY_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY host, minute, dst_port ORDER BY ts, event_id) AS pn, row_number() OVER (PARTITION BY host, minute, process ORDER BY ts, event_id) AS qn FROM h)
    SELECT event_id, host, minute, count(*) OVER w AS rate, CAST(sum(CASE WHEN pn = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS ports, CAST(sum(CASE WHEN qn = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS procs, CAST(sum(bytes_sent) OVER w AS BIGINT) AS bytes
    FROM f WINDOW w AS (PARTITION BY host, minute ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def minute_counters(spark, sf_dir):
    return detect.minute_counters(hourly(spark, sf_dir)).select("event_id", "host", "minute", "rate", "ports", "procs", "bytes")


@query("w02_ewma_baseline")
def ewma_baseline(spark, sf_dir):
    return detect.ewma_baseline(detect.minute_buckets(hourly(spark, sf_dir)))


@query("w03_statistical_detections")
def statistical_detections(spark, sf_dir):
    return detect.statistical_detections(hourly(spark, sf_dir))


@query("w04_baseline_snapshot")
def baseline_snapshot(spark, sf_dir):
    return detect.baseline_snapshot(detect.minute_buckets(hourly(spark, sf_dir)))


@query(
    "a26_confusion_metrics",
    f"""WITH {SCORES_SQL}, c AS (SELECT model_id, version, count(*) FILTER (score >= 0.5 AND label >= 0.5) AS tp, count(*) FILTER (score >= 0.5 AND label < 0.5) AS fp,
      count(*) FILTER (score < 0.5 AND label < 0.5) AS tn, count(*) FILTER (score < 0.5 AND label >= 0.5) AS fn FROM scores WHERE label IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
    SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM r""",
)
def confusion_metrics(spark, sf_dir):
    return quality.confusion_metrics(scores(spark, sf_dir), by=("model_id", "version"))


@query(
    "a27_auc_trapezoid",
    f"""WITH {SCORES_SQL}, t AS (SELECT unnest(range(51)) AS i), l AS (SELECT score, label >= 0.5 AS pos FROM scores WHERE label IS NOT NULL),
    c AS (SELECT i, count(*) FILTER (pos) / (SELECT count(*) FROM l WHERE pos) AS tpr, count(*) FILTER (NOT pos) / (SELECT count(*) FROM l WHERE NOT pos) AS fpr
      FROM t JOIN l ON least(50, floor(score * 50 + 1e-12)) >= i GROUP BY i),
    g AS (SELECT (fpr - lag(fpr) OVER (ORDER BY fpr, tpr)) * (tpr + lag(tpr) OVER (ORDER BY fpr, tpr)) / 2 AS area FROM c)
    SELECT round(sum(area), 9) AS auc FROM g""",
)
def auc_trapezoid(spark, sf_dir):
    return quality.auc_trapezoid(scores(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(
    "a28_score_distribution",
    f"""WITH {SCORES_SQL} SELECT model_id, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99 FROM scores GROUP BY 1""",
)
def score_distribution(spark, sf_dir):
    out = quality.score_distribution(scores(spark, sf_dir), ("model_id",))
    return out.select("model_id", *(F.round(c, 9).alias(c) for c in ("mean", "std", "p50", "p95", "p99")))


def halves(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.where("version = 1"), s.where("version = 2")


_CUSUM_SQL = """ref AS (SELECT avg(score) AS mean, stddev_pop(score) AS std FROM scores WHERE version = 1),
    st AS (SELECT seq, sum(score - mean - 0.5 * std) OVER (ORDER BY seq) AS s, std FROM scores, ref WHERE version = 2),
    cu AS (SELECT round(greatest(0, max(c)) / any_value(std), 4) AS cusum FROM (SELECT s - least(0, min(s) OVER (ORDER BY seq)) AS c, std FROM st))"""
_PSI_SQL = """edge AS (SELECT min(score) AS lo, max(score) AS hi FROM scores WHERE version = 1),
    b AS (SELECT version, greatest(0, least(9, CAST(floor((score - lo) / ((hi - lo) / 10)) AS INT))) AS bin FROM scores, edge),
    sh AS (SELECT r.bin, greatest(1e-9, coalesce((SELECT count(*) FROM b WHERE version = 1 AND b.bin = r.bin) / (SELECT count(*) FROM b WHERE version = 1), 0)) AS p,
      greatest(1e-9, coalesce((SELECT count(*) FROM b WHERE version = 2 AND b.bin = r.bin) / (SELECT count(*) FROM b WHERE version = 2), 0)) AS q FROM (SELECT unnest(range(10)) AS bin) r),
    ps AS (SELECT round(sum((q - p) * ln(q / p)), 4) AS psi FROM sh)"""
_KS_SQL = """kc AS (SELECT score, count(*) FILTER (version = 1) AS r, count(*) FILTER (version = 2) AS c FROM scores GROUP BY 1),
    kg AS (SELECT abs(sum(r) OVER w / (SELECT sum(r) FROM kc) - sum(c) OVER w / (SELECT sum(c) FROM kc)) AS gap FROM kc WINDOW w AS (ORDER BY score)),
    ks AS (SELECT round(max(gap), 4) AS ks FROM kg)"""


@query("w14_cusum", f"WITH {SCORES_SQL}, {_CUSUM_SQL} SELECT * FROM cu")
def cusum(spark, sf_dir):
    return quality.cusum(*halves(spark, sf_dir))


@query("w15_psi", f"WITH {SCORES_SQL}, {_PSI_SQL} SELECT * FROM ps")
def psi(spark, sf_dir):
    return quality.psi(*halves(spark, sf_dir))


@query("w16_ks_statistic", f"WITH {SCORES_SQL}, {_KS_SQL} SELECT * FROM ks")
def ks_statistic(spark, sf_dir):
    return quality.ks_statistic(*halves(spark, sf_dir))


@query(
    "w17_drift_report",
    f"""WITH {SCORES_SQL}, {_CUSUM_SQL}, {_PSI_SQL}, {_KS_SQL}
    SELECT cusum, psi, ks, round(0.4 * least(1, cusum) + 0.35 * least(1, psi / 0.25) + 0.25 * least(1, ks / 0.3), 4) AS composite, cusum > 1 OR psi > 0.25 OR ks > 0.3 AS triggered,
      CASE WHEN 0.4 * least(1, cusum) + 0.35 * least(1, psi / 0.25) + 0.25 * least(1, ks / 0.3) < 0.1 THEN 'none' WHEN 0.4 * least(1, cusum) + 0.35 * least(1, psi / 0.25) + 0.25 * least(1, ks / 0.3) < 0.3 THEN 'low'
        WHEN 0.4 * least(1, cusum) + 0.35 * least(1, psi / 0.25) + 0.25 * least(1, ks / 0.3) < 0.5 THEN 'medium' WHEN 0.4 * least(1, cusum) + 0.35 * least(1, psi / 0.25) + 0.25 * least(1, ks / 0.3) < 0.75 THEN 'high' ELSE 'critical' END AS severity,
      (SELECT count(*) FROM scores WHERE version = 1) AS reference_size, (SELECT count(*) FROM scores WHERE version = 2) AS current_size FROM cu, ps, ks""",
)
def drift_report(spark, sf_dir):
    return quality.drift_report(*halves(spark, sf_dir)).drop("reference_mean", "current_mean")


@query("w20_recent_scores", f"WITH {SCORES_SQL} SELECT model_id, version, seq FROM scores QUALIFY row_number() OVER (PARTITION BY model_id, version ORDER BY seq DESC) <= 100")
def recent_scores(spark, sf_dir):
    return quality.recent_scores(scores(spark, sf_dir), 100).select("model_id", "version", "seq")


@query(
    "w19_model_lifecycle",
    """WITH e AS (SELECT 'm' || (o_custkey % 40) AS model_id, o_orderkey AS seq, o_orderstatus FROM orders),
    r AS (SELECT model_id, seq AS registered, row_number() OVER (PARTITION BY model_id ORDER BY seq) AS version FROM e),
    p AS (SELECT model_id, 1 + seq % 20 AS version, max(seq) AS promoted FROM e WHERE o_orderstatus = 'F' GROUP BY ALL)
    SELECT r.model_id, r.version, r.registered, CASE WHEN promoted IS NULL THEN 'staging' WHEN promoted = max(promoted) OVER (PARTITION BY r.model_id) THEN 'production' ELSE 'retired' END AS status
    FROM r LEFT JOIN p USING (model_id, version)""",
)
def model_lifecycle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    model = F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string")).alias("model_id")
    register = orders.select(model, F.col("o_orderkey").alias("seq"), F.lit("register").alias("action"), F.lit(None).cast("long").alias("version"))
    promote = orders.where("o_orderstatus = 'F'").select(model, F.col("o_orderkey").alias("seq"), F.lit("promote").alias("action"), (1 + F.col("o_orderkey") % 20).alias("version"))
    return quality.model_lifecycle(register.unionByName(promote))


@query(
    "a36_set_metrics",
    f"""WITH {DET_SQL}, u AS (SELECT event_id, score >= 0.5 AS p, status = 'failure' AS t FROM det), c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
      count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (NOT p AND t) AS fn FROM u), r AS (SELECT *, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall FROM c)
    SELECT *, 2 * "precision" * recall / ("precision" + recall) AS f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy, fp / (fp + tn) AS fpr FROM r""",
)
def set_metrics(spark, sf_dir):
    det = detections(spark, sf_dir)
    return quality.set_metrics(det.where("score >= 0.5"), det.where("status = 'failure'"), det, "event_id")

"""Coverage of techniques and controls, over rules, techniques and controls as views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage
from ..sources.standins import DET_SQL, detections
from .registry import query

COV_SQL = """rules AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'T' || (1000 + p_partkey % 80) || '.RULE' || p_partkey ELSE 'R' || p_partkey END AS rule_id, ['low', 'medium', 'high'][1 + p_partkey % 3] AS severity,
    CASE WHEN p_partkey % 2 = 0 THEN ['mitre:t' || (1000 + p_partkey % 50) || CASE WHEN p_partkey % 4 = 0 THEN '.001' ELSE '' END, 'execution'] ELSE ['T' || (1000 + p_partkey % 60), 'attack.t1003'] END AS tags FROM part),
  tech AS (SELECT 'T' || (999 + s_suppkey) || CASE WHEN s_suppkey % 10 = 0 THEN '.001' ELSE '' END AS technique_id, ['tactic' || (s_suppkey % 5), 'tactic' || (5 + s_suppkey % 3)] AS tactics FROM supplier),
  controls AS (SELECT 'C' || c_custkey AS control_id, 'F' || c_nationkey AS family, ['T' || (1000 + c_custkey % 120), 'T' || (1000 + c_custkey % 77), 'T' || (1000 + c_custkey % 91)] AS techniques FROM customer),
  rt AS (SELECT DISTINCT rule_id, severity, unnest(list_concat(list_transform(list_filter(tags, lambda t: starts_with(lower(t), 'mitre:')), lambda t: upper(t[7:])), list_transform(list_filter(tags, lambda t: regexp_matches(upper(t), '^T\\d{4}')), lambda t: upper(t)),
      CASE WHEN regexp_matches(rule_id, '^T\\d{4}') THEN [split_part(rule_id, '.', 1)] ELSE [] END)) AS technique_id FROM rules),
  lk AS (SELECT rule_id, technique_id AS named, coalesce((SELECT max(technique_id) FROM tech t WHERE t.technique_id = rt.technique_id), (SELECT max(technique_id) FROM tech t WHERE t.technique_id = split_part(rt.technique_id, '.', 1))) AS known_id FROM rt),
  cov AS (SELECT coalesce(known_id, named) AS technique_id, known_id IS NOT NULL AS known, count(*) AS rule_count, list_sort(list(DISTINCT rule_id)) AS rule_ids FROM lk GROUP BY 1, 2),
  met AS (SELECT DISTINCT rule_id, technique_id AS technique FROM rt UNION SELECT rule_id, split_part(technique_id, '.', 1) FROM rt),
  wanted AS (SELECT control_id, family, unnest(list_distinct(techniques)) AS technique FROM controls),
  cc AS (SELECT w.control_id, w.family, count(DISTINCT m.technique) > 0 AS covered, round(count(DISTINCT m.technique) / count(DISTINCT w.technique), 4) AS fraction,
    coalesce(list_sort(list(DISTINCT w.technique) FILTER (m.technique IS NULL)), []) AS missing FROM wanted w LEFT JOIN met m ON m.technique = w.technique GROUP BY 1, 2)"""


def rules(spark, sf_dir):
    p = F.col("p_partkey")
    s = lambda x: x.cast("string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.when(p % 3 == 0, F.concat(F.lit("T"), s(1000 + p % 80), F.lit(".RULE"), s(p))).otherwise(F.concat(F.lit("R"), s(p))).alias("rule_id"),
        F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (p % 3).cast("int")).alias("severity"),
        F.when(p % 2 == 0, F.array(F.concat(F.lit("mitre:t"), s(1000 + p % 50), F.when(p % 4 == 0, ".001").otherwise("")), F.lit("execution"))).otherwise(F.array(F.concat(F.lit("T"), s(1000 + p % 60)), F.lit("attack.t1003"))).alias("tags"),
    )


def techniques(spark, sf_dir):
    k = F.col("s_suppkey")
    s = lambda x: x.cast("string")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("T"), s(999 + k), F.when(k % 10 == 0, ".001").otherwise("")).alias("technique_id"), F.array(F.concat(F.lit("tactic"), s(k % 5)), F.concat(F.lit("tactic"), s(5 + k % 3))).alias("tactics")
    )


def controls(spark, sf_dir):
    k = F.col("c_custkey")
    t = lambda n: F.concat(F.lit("T"), (1000 + k % n).cast("string"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("C"), k.cast("string")).alias("control_id"), F.concat(F.lit("F"), F.col("c_nationkey").cast("string")).alias("family"), F.array(t(120), t(77), t(91)).alias("techniques"))


def covered(spark, sf_dir):
    return coverage.coverage_map(rules(spark, sf_dir), techniques(spark, sf_dir))


def control_table(spark, sf_dir):
    return coverage.control_coverage(controls(spark, sf_dir), rules(spark, sf_dir))


@query("p26_technique_ids", f"WITH {COV_SQL} SELECT rule_id, string_agg(technique_id, ',' ORDER BY technique_id) AS techniques FROM rt GROUP BY 1")
def technique_ids(spark, sf_dir):
    return rules(spark, sf_dir).select("rule_id", F.array_join(coverage.technique_ids(F.col("rule_id"), F.col("tags")), ",").alias("techniques")).where("techniques <> ''")


@query("p27_normalize_rule_tags", f"WITH {COV_SQL} SELECT rule_id, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: CASE WHEN starts_with(t, 'attack.') THEN 'mitre:' || upper(t[8:]) ELSE lower(t) END))), ',') AS tags FROM rules")
def normalize_rule_tags(spark, sf_dir):
    return rules(spark, sf_dir).select("rule_id", F.array_join(coverage.normalize_rule_tags(F.col("tags")), ",").alias("tags"))


@query("j12_technique_lookup", f"WITH {COV_SQL} SELECT rule_id, named AS technique_id, known_id FROM lk")
def technique_lookup(spark, sf_dir):
    return coverage.technique_lookup(coverage.rule_techniques(rules(spark, sf_dir)), techniques(spark, sf_dir)).select("rule_id", "technique_id", "known_id")


@query("a21_coverage_map", f"WITH {COV_SQL} SELECT technique_id, known, rule_count, array_to_string(rule_ids, ',') AS rule_ids FROM cov")
def coverage_map(spark, sf_dir):
    return covered(spark, sf_dir).withColumn("rule_ids", F.array_join("rule_ids", ","))


@query("a22_coverage_by_tactic", f"WITH {COV_SQL}, t AS (SELECT technique_id, unnest(tactics) AS tactic FROM tech) SELECT tactic, count(*) AS total, count(*) FILTER (technique_id IN (SELECT technique_id FROM cov WHERE known)) AS covered FROM t GROUP BY 1")
def coverage_by_tactic(spark, sf_dir):
    return coverage.coverage_by_tactic(covered(spark, sf_dir), techniques(spark, sf_dir))


@query(
    "a22_coverage_summary",
    f"""WITH {COV_SQL}, s AS (SELECT (SELECT count(*) FROM tech WHERE technique_id NOT LIKE '%.%') AS total, (SELECT count(DISTINCT split_part(technique_id, '.', 1)) FROM cov WHERE known) AS covered) SELECT *, round(covered / total, 4) AS fraction FROM s""",
)
def coverage_summary(spark, sf_dir):
    return coverage.coverage_summary(covered(spark, sf_dir), techniques(spark, sf_dir))


@query("a22_uncovered_techniques", f"WITH {COV_SQL} SELECT technique_id FROM tech WHERE technique_id NOT LIKE '%.%' AND technique_id NOT IN (SELECT technique_id FROM cov WHERE known)")
def uncovered_techniques(spark, sf_dir):
    return coverage.uncovered_techniques(covered(spark, sf_dir), techniques(spark, sf_dir))


@query("j18_rule_control_map", f"WITH {COV_SQL} SELECT control_id, technique, count(DISTINCT rule_id) AS rules FROM wanted JOIN met USING (technique) GROUP BY 1, 2")
def rule_control_map(spark, sf_dir):
    return coverage.control_rule_counts(controls(spark, sf_dir), rules(spark, sf_dir))


@query("a23_control_coverage", f"WITH {COV_SQL} SELECT control_id, family, covered, fraction, array_to_string(missing, ',') AS missing FROM cc")
def control_coverage(spark, sf_dir):
    return control_table(spark, sf_dir).withColumn("missing", F.array_join("missing", ","))


@query("a23_family_totals", f"WITH {COV_SQL} SELECT family, count(*) AS total, count(*) FILTER (covered) AS covered FROM cc GROUP BY ROLLUP (family)")
def family_totals(spark, sf_dir):
    return coverage.family_totals(control_table(spark, sf_dir))


@query("a24_gap_analysis", f"WITH {COV_SQL}, m AS (SELECT unnest(missing) AS technique FROM cc) SELECT technique, count(*) AS unlocks FROM m GROUP BY 1")
def gap_analysis(spark, sf_dir):
    return coverage.missing_techniques(control_table(spark, sf_dir))


@query(
    "a25_compliance_posture",
    f"""WITH {COV_SQL}, s AS (SELECT count(*) AS total, count(*) FILTER (covered) AS covered FROM cc), f AS (SELECT *, round(covered / total, 4) AS fraction FROM s)
    SELECT *, CASE WHEN fraction >= 0.9 THEN 'strong' WHEN fraction >= 0.66 THEN 'moderate' WHEN fraction >= 0.33 THEN 'developing' ELSE 'initial' END AS posture FROM f""",
)
def compliance_posture(spark, sf_dir):
    return coverage.compliance_posture(control_table(spark, sf_dir))


_STEPS = """steps AS (SELECT event_id % 200 AS step_id, 'T' || (1000 + event_id % 20) AS technique, event_id % 200 % 4 <> 0 AS expected, event_id FROM events),
    sc AS (SELECT step_id, technique, expected, count(score) > 0 AS detected, max(score) AS max_score FROM steps LEFT JOIN (SELECT event_id, score FROM det WHERE score >= 0.8) d USING (event_id) GROUP BY 1, 2, 3)"""


def scenario(spark, sf_dir):
    e = F.col("event_id")
    events = detections(spark, sf_dir)
    steps = events.select((e % 200).alias("step_id"), F.concat(F.lit("T"), (1000 + e % 20).cast("string")).alias("technique"), (e % 200 % 4 != 0).alias("expected"), "event_id")
    return coverage.detection_coverage(steps, events.where("score >= 0.8"))


@query("j14_detection_coverage", f"WITH {DET_SQL}, {_STEPS} SELECT * FROM sc")
def detection_coverage(spark, sf_dir):
    return scenario(spark, sf_dir)


@query(
    "j14_coverage_grade",
    f"""WITH {DET_SQL}, {_STEPS}, g AS (SELECT count(*) FILTER (expected) AS expected, count(*) FILTER (expected AND detected) AS detected, count(*) FILTER (expected AND NOT detected) AS missed, count(*) FILTER (NOT expected AND detected) AS unexpected FROM sc),
    r AS (SELECT *, round(detected / expected, 4) AS rate FROM g) SELECT *, CASE WHEN rate >= 0.9 THEN 'A' WHEN rate >= 0.75 THEN 'B' WHEN rate >= 0.5 THEN 'C' WHEN rate > 0 THEN 'D' ELSE 'F' END AS grade FROM r""",
)
def coverage_grade(spark, sf_dir):
    return coverage.coverage_grade(scenario(spark, sf_dir))


@query("s27_navigator_layer", f"""WITH {COV_SQL} SELECT '{{"techniqueID":"' || technique_id || '","score":' || rule_count || ',"color":"' || ['#f7f7f7', '#fdd49e', '#fdae6b', '#fd8d3c', '#e6550d', '#a63603'][1 + least(5, rule_count)] || '","comment":"' || array_to_string(rule_ids[1:8], ', ') || '"}}' AS entry FROM cov WHERE known""")
def navigator_layer(spark, sf_dir):
    return coverage.navigator_layer(covered(spark, sf_dir))


@query("s27_navigator_gradient", f"WITH {COV_SQL} SELECT '#f7f7f7,#fdd49e,#fdae6b,#fd8d3c,#e6550d,#a63603' AS colors, 0 AS min_value, greatest(1, coalesce(max(rule_count), 1)) AS max_value FROM cov WHERE known")
def navigator_gradient(spark, sf_dir):
    return coverage.navigator_gradient(covered(spark, sf_dir))

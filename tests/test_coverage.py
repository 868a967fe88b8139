"""Rules by control, counted before they are joined."""

from pyspark.sql import functions as F

from sentrylake.operators import coverage


def tables(spark, n):
    rules = spark.range(n).select(F.concat(F.lit("R"), "id").alias("rule_id"), F.lit("low").alias("severity"), F.array(F.lit("mitre:t1001.001"), F.concat(F.lit("T"), 1000 + F.col("id") % 7)).alias("tags"))
    controls = spark.range(n).select(F.concat(F.lit("C"), "id").alias("control_id"), F.array(F.concat(F.lit("T"), 1000 + F.col("id") % 9), F.lit("T1001.001")).alias("techniques"))
    return controls, rules


def test_counts_as_pairs(spark):
    controls, rules = tables(spark, 60)
    # repeated rows of both sides count once
    controls, rules = controls.unionByName(controls.limit(5)), rules.unionByName(rules.limit(5))
    want = coverage.control_rules(controls, rules).groupBy("control_id", "technique").agg(F.countDistinct("rule_id").alias("rules"))
    got = coverage.control_rule_counts(controls, rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_map_makes_no_pairs(spark, sf):
    """No operator of the plan gives rows of rules times controls."""
    from sentrylake.plans import catalog

    df = catalog.QUERIES["j18_rule_control_map"](spark, sf)
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert len(joins) == 1 and "rule_id" not in str(df.columns)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]

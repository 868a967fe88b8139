"""Detection coverage of techniques and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def technique_ids(rule_id: Column, tags: Column) -> Column:
    """Techniques of ``mitre:T...`` tags, of tags that are one, and of the rule id's first part; sorted, each once."""
    tagged = F.transform(F.filter(tags, lambda t: F.lower(t).startswith("mitre:")), lambda t: F.upper(F.substring(t, 7, 64)))
    raw = F.transform(F.filter(tags, lambda t: F.upper(t).rlike(r"^T\d{4}")), F.upper)
    prefix = F.substring_index(rule_id, ".", 1)
    own = F.when(prefix.rlike(r"^T\d{4}"), F.array(F.upper(prefix))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(tagged, raw, own)))


def normalize_rule_tags(tags: Column) -> Column:
    """``attack.x`` becomes ``mitre:X``, all others lower case; sorted, each once."""
    attack = r"(?i)^attack\."
    plain = F.transform(tags, lambda t: F.when(t.rlike(attack), F.concat(F.lit("mitre:"), F.upper(F.regexp_replace(t, attack, "")))).otherwise(F.lower(t)))
    return F.array_sort(F.array_distinct(plain))


def rule_techniques(rules: DataFrame) -> DataFrame:
    """(rule_id, severity, technique_id): one row for each technique of a rule."""
    return rules.select("rule_id", "severity", F.explode(technique_ids(F.col("rule_id"), F.col("tags"))).alias("technique_id"))


def technique_lookup(ids: DataFrame, techniques: DataFrame) -> DataFrame:
    """Ids with the technique they name, else the one before their dot, else null (column known_id)."""
    exact = techniques.select(F.col("technique_id").alias("_e"))
    parent = techniques.select(F.col("technique_id").alias("_p"))
    joined = ids.join(exact, F.col("technique_id") == F.col("_e"), "left").join(parent, F.substring_index("technique_id", ".", 1) == F.col("_p"), "left")
    return joined.withColumn("known_id", F.coalesce("_e", "_p")).drop("_e", "_p")


def coverage_map(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(technique_id, known, rule_count, rule_ids) of every technique that a rule names; unknown ones apart."""
    found = technique_lookup(rule_techniques(rules), techniques)
    key = F.coalesce("known_id", "technique_id").alias("technique_id")
    return found.groupBy(key, F.col("known_id").isNotNull().alias("known")).agg(F.count("*").alias("rule_count"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def coverage_by_tactic(coverage: DataFrame, techniques: DataFrame) -> DataFrame:
    """(tactic, total, covered)."""
    covered = coverage.where("known").select("technique_id").withColumn("covered", F.lit(1))
    rows = techniques.join(covered, "technique_id", "left").select(F.explode("tactics").alias("tactic"), "covered")
    return rows.groupBy("tactic").agg(F.count("*").alias("total"), F.count("covered").alias("covered"))


def coverage_summary(coverage: DataFrame, techniques: DataFrame) -> DataFrame:
    """(total, covered, fraction) over parent techniques."""
    total = techniques.where(~F.col("technique_id").contains(".")).agg(F.count("*").alias("total"))
    covered = coverage.where("known").agg(F.countDistinct(F.substring_index("technique_id", ".", 1)).alias("covered"))
    return total.join(covered).withColumn("fraction", F.round(F.col("covered") / F.greatest("total", F.lit(1)), 4))


def uncovered_techniques(coverage: DataFrame, techniques: DataFrame) -> DataFrame:
    """Parent techniques that no rule covers."""
    return techniques.where(~F.col("technique_id").contains(".")).join(coverage.where("known").select("technique_id"), "technique_id", "left_anti").select("technique_id")


def control_rules(controls: DataFrame, rules: DataFrame) -> DataFrame:
    """(control_id, technique, rule_id): a rule meets a control's technique by its id or, for a parent, by any below it."""
    met = rule_techniques(rules).select("rule_id", F.explode(F.array_distinct(F.array("technique_id", F.substring_index("technique_id", ".", 1)))).alias("technique"))
    wanted = controls.select("control_id", F.explode(F.array_distinct("techniques")).alias("technique"))
    return wanted.join(met.distinct(), "technique")


def control_rule_counts(controls: DataFrame, rules: DataFrame) -> DataFrame:
    """(control_id, technique, rules): how many rules ``control_rules`` gives of each pair; rules are counted by technique before controls are joined."""
    met = rule_techniques(rules).select("rule_id", F.explode(F.array_distinct(F.array("technique_id", F.substring_index("technique_id", ".", 1)))).alias("technique"))
    counts = met.groupBy("technique").agg(F.countDistinct("rule_id").alias("rules"))
    wanted = controls.select("control_id", F.explode(F.array_distinct("techniques")).alias("technique")).distinct()
    return wanted.join(counts, "technique").select("control_id", "technique", "rules")


def control_coverage(controls: DataFrame, rules: DataFrame) -> DataFrame:
    """(control_id, family, covered, fraction, missing): how much of each control's techniques rules meet."""
    met = F.explode(F.array_distinct(F.array("technique_id", F.substring_index("technique_id", ".", 1)))).alias("technique")
    # which rules meet a technique does not matter here, so each technique is one row
    met = rule_techniques(rules).select(met).distinct()
    wanted = controls.select("control_id", F.explode(F.array_distinct("techniques")).alias("technique"))
    met = wanted.join(met, "technique", "left_semi").groupBy("control_id").agg(F.array_sort(F.collect_set("technique")).alias("met"))
    wanted = F.array_distinct("techniques")
    met_or_none = F.coalesce("met", F.array().cast("array<string>"))
    fraction = F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.round(F.size(met_or_none) / F.size(wanted), 4))
    return controls.join(met, "control_id", "left").select("control_id", "family", (F.size(met_or_none) > 0).alias("covered"), fraction.alias("fraction"), F.array_sort(F.array_except(wanted, met_or_none)).alias("missing"))


def family_totals(coverage: DataFrame) -> DataFrame:
    """(family, total, covered) of each family, and of all (family null)."""
    return coverage.rollup("family").agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"))


def missing_techniques(coverage: DataFrame) -> DataFrame:
    """(technique, unlocks): techniques that uncovered and partly covered controls lack, by how many do."""
    return coverage.select(F.explode("missing").alias("technique")).groupBy("technique").agg(F.count("*").alias("unlocks"))


def compliance_posture(coverage: DataFrame) -> DataFrame:
    """(total, covered, fraction, posture): strong from 0.9, moderate from 0.66, developing from 0.33, else initial."""
    row = coverage.agg(F.count("*").alias("total"), F.count_if("covered").alias("covered")).withColumn("fraction", F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 4)).otherwise(F.lit(0.0)))
    f = F.col("fraction")
    return row.withColumn("posture", F.when(f >= 0.9, "strong").when(f >= 0.66, "moderate").when(f >= 0.33, "developing").otherwise("initial"))


def detection_coverage(steps: DataFrame, detections: DataFrame) -> DataFrame:
    """(step_id, technique, expected, detected, max_score) of scenario steps (step_id, technique, expected, event_id)."""
    best = detections.groupBy("event_id").agg(F.max("score").alias("score"))
    return steps.join(best, "event_id", "left").groupBy("step_id", "technique", "expected").agg(F.bool_or(F.col("score").isNotNull()).alias("detected"), F.max("score").alias("max_score"))


def coverage_grade(steps: DataFrame) -> DataFrame:
    """(expected, detected, missed, unexpected, rate, grade) over steps."""
    e, d = F.col("expected"), F.col("detected")
    row = steps.agg(F.count_if(e).alias("expected"), F.count_if(e & d).alias("detected"), F.count_if(e & ~d).alias("missed"), F.count_if(~e & d).alias("unexpected"))
    rate = F.when(F.col("expected") > 0, F.round(F.col("detected") / F.col("expected"), 4)).otherwise(F.lit(1.0))
    row = row.withColumn("rate", rate)
    r = F.col("rate")
    return row.withColumn("grade", F.when(r >= 0.9, "A").when(r >= 0.75, "B").when(r >= 0.5, "C").when(r > 0, "D").otherwise("F"))


#: Colours by number of rules, the last for that many and more.
COVERAGE_COLORS = ("#f7f7f7", "#fdd49e", "#fdae6b", "#fd8d3c", "#e6550d", "#a63603")


def navigator_layer(coverage: DataFrame) -> DataFrame:
    """A technique's JSON entry: score 1 for each rule, its colour, and a comment of at most 8 rule ids."""
    colour = F.element_at(F.array(*map(F.lit, COVERAGE_COLORS)), F.least(F.col("rule_count"), F.lit(len(COVERAGE_COLORS) - 1)).cast("int") + 1)
    entry = F.struct(F.col("technique_id").alias("techniqueID"), F.col("rule_count").alias("score"), colour.alias("color"), F.array_join(F.slice("rule_ids", 1, 8), ", ").alias("comment"))
    return coverage.where("known").select(F.to_json(entry).alias("entry"))


def navigator_gradient(coverage: DataFrame) -> DataFrame:
    """(colors, min_value, max_value) of a layer, whose greatest value is that of its techniques, 1 at least."""
    top = F.greatest(F.lit(1), F.coalesce(F.max("rule_count"), F.lit(1)))
    return coverage.where("known").agg(top.alias("max_value")).select(F.array_join(F.array(*map(F.lit, COVERAGE_COLORS)), ",").alias("colors"), F.lit(0).alias("min_value"), "max_value")


def technique_search(techniques: DataFrame, text: str) -> DataFrame:
    """techniques whose id, name or description has the text, in any case."""
    found = F.lit(False)
    for c in ("technique_id", "name", "description"):
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return techniques.where(found)


def techniques_of(techniques: DataFrame, tactic: str) -> DataFrame:
    """techniques of a tactic."""
    return techniques.where(F.array_contains("tactics", tactic))

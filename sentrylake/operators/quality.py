"""Model metrics, drift and life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order_stats import percentiles


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _confusion(hit: Column, truth: Column) -> list[Column]:
    return [F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & ~truth).alias("tn"), F.count_if(~hit & truth).alias("fn")]


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return df.select(
        "*", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(fp, fp + tn).alias("fpr"),
    )


def confusion_metrics(scores: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates of (score, label); rows without a label are left out, a label of 0.5 or more is positive."""
    rows = scores.where("label is not null")
    return _rates(rows.groupBy(*by).agg(*_confusion(F.col("score") >= threshold, F.col("label") >= 0.5)))


def auc_trapezoid(scores: DataFrame, steps: int = 50) -> DataFrame:
    """The area under the curve through ``steps`` + 1 thresholds from 0 to 1, by trapezoids.

    One pass: each score falls between two thresholds; what lies at or above a
    threshold is a running sum over so many bins.
    """
    labelled = scores.where("label is not null").select(F.least(F.lit(steps), F.floor(F.col("score") * steps + 1e-12)).cast("int").alias("bin"), (F.col("label") >= 0.5).alias("pos"))
    counts = labelled.groupBy("bin").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))
    every = scores.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("bin"))
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy()
    points = every.join(counts, "bin", "left").na.fill(0).withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down))
    points = points.select(_ratio(F.col("fp"), F.sum("n").over(all_)).alias("fpr"), _ratio(F.col("tp"), F.sum("p").over(all_)).alias("tpr"))
    order = Window.orderBy("fpr", "tpr")
    area = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("tpr") + F.lag("tpr").over(order)) / 2
    return points.withColumn("area", area).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("auc"))


def score_distribution(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation and interpolated percentiles, exact whatever the number of different scores.  Scores of null groups are left out."""
    known = scores
    for c in by:
        known = known.where(F.col(c).isNotNull())
    moments = known.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    at = percentiles(known, list(by), "score", [0.5, 0.95, 0.99])
    joined = moments.join(at, list(by), "left") if by else moments.crossJoin(F.broadcast(at))
    return joined.select(*by, "mean", "std", *(F.get("p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((50, 95, 99))))


def _prefix_sums(df: DataFrame, value: Column, order: str, rows_per_part: int = 100_000) -> DataFrame:
    """``df`` with the running sum of ``value`` in ``order`` (a number from 0, each once), without one task holding all rows."""
    part = F.floor(F.col(order) / rows_per_part)
    rows = df.withColumn("_v", value).withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(base, "_part").withColumn("running", F.col("_base") + F.sum("_v").over(within)).drop("_v", "_base")


def cusum(reference: DataFrame, current: DataFrame, order: str = "seq") -> DataFrame:
    """(cusum): the peak of c := max(0, c + (x - mean) - std / 2), over std.

    Closed form: c after row n is the running sum S_n less the least of 0 and
    all S up to n.  The running minimum goes part by part as the sums do.
    """
    ref = reference.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).select("mean", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1e-9)).alias("std"))
    step = F.col("score") - F.col("mean") - 0.5 * F.col("std")
    sums = _prefix_sums(current.join(F.broadcast(ref)), step, order)
    lows = sums.groupBy("_part").agg(F.min("running").alias("low"))
    before = lows.select("_part", F.min("low").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = sums.join(before, "_part").withColumn("c", F.col("running") - F.least(F.lit(0.0), F.min("running").over(within), F.coalesce("before", F.lit(0.0))))
    return level.agg(F.greatest(F.lit(0.0), F.max("c")).alias("peak"), F.max("std").alias("std")).select(F.round(F.coalesce(F.col("peak") / F.greatest("std", F.lit(1e-9)), F.lit(0.0)), 4).alias("cusum"))


def psi(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """(psi): population stability over the reference's equal bins; empty bins count as 1e-9."""
    edge = reference.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).select("lo", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1e-9).otherwise(F.col("hi")).alias("hi"))
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).cast("int")

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.join(F.broadcast(edge)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"))
        return counts.select("bin", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias(name))

    every = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = every.join(shares(reference, "r"), "bin", "left").join(shares(current, "c"), "bin", "left")
    r, c = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(1e-9)) for x in ("r", "c"))
    return both.agg(F.round(F.sum((c - r) * F.log(c / r)), 4).alias("psi"))


def ks_statistic(reference: DataFrame, current: DataFrame, parts: int = 64) -> DataFrame:
    """(ks): the largest gap of the two distribution functions.

    Values are counted, cut into parts by quantiles, and summed part by part.
    """
    both = reference.select("score", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select("score", F.lit(0).alias("r"), F.lit(1).alias("c")))
    counts = both.groupBy("score").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    cuts = counts.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)]).alias("cuts"))
    placed = counts.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda q: q < F.col("score")))).drop("cuts")
    sums = placed.groupBy("part").agg(F.sum("r").alias("sr"), F.sum("c").alias("sc"))
    earlier, all_ = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    base = sums.select("part", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"b{x}") for x in ("sr", "sc")), *(F.sum(x).over(all_).alias(f"t{x}") for x in ("sr", "sc")))
    within = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs((F.col("bsr") + F.sum("r").over(within)) / F.col("tsr") - (F.col("bsc") + F.sum("c").over(within)) / F.col("tsc"))
    return placed.join(base, "part").withColumn("gap", gap).agg(F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 4).alias("ks"))


#: Thresholds and weights of the composite, and the severities by its value.
CUSUM_AT, PSI_AT, KS_AT = 1.0, 0.25, 0.3
WEIGHTS = (0.4, 0.35, 0.25)


#: Severities of a drift by the composite that each ends below.
DRIFT_SEVERITIES = ("none", "low", "medium", "high", "critical")
DRIFT_BANDS = (0.1, 0.3, 0.5, 0.75)


def drift_severity(composite: Column) -> Column:
    out = F.lit(DRIFT_SEVERITIES[-1])
    for name, end in reversed(tuple(zip(DRIFT_SEVERITIES, DRIFT_BANDS))):
        out = F.when(composite < end, F.lit(name)).otherwise(out)
    return F.when(composite.isNotNull(), out)


def drift_report(reference: DataFrame, current: DataFrame, order: str = "seq") -> DataFrame:
    """One row with the three measures, their composite, its severity, whether one is over its threshold, and both means."""
    row = cusum(reference, current, order).join(psi(reference, current)).join(ks_statistic(reference, current))
    means = reference.agg(F.avg("score").alias("reference_mean"), F.count("*").alias("reference_size")).join(current.agg(F.avg("score").alias("current_mean"), F.count("*").alias("current_size")))
    parts = [w * F.least(F.lit(1.0), F.col(c) / at) for w, c, at in zip(WEIGHTS, ("cusum", "psi", "ks"), (CUSUM_AT, PSI_AT, KS_AT))]
    composite = parts[0] + parts[1] + parts[2]
    row = row.join(means).withColumn("severity", drift_severity(composite)).withColumn("composite", F.round(composite, 4))
    return row.withColumn("triggered", (F.col("cusum") > CUSUM_AT) | (F.col("psi") > PSI_AT) | (F.col("ks") > KS_AT))


def set_metrics(predicted: DataFrame, truth: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """Confusion counts and rates of two id sets within a third."""
    rows = universe.select(key).distinct().join(predicted.select(key).distinct().withColumn("p", F.lit(True)), key, "left").join(truth.select(key).distinct().withColumn("t", F.lit(True)), key, "left")
    return _rates(rows.agg(*_confusion(F.coalesce("p", F.lit(False)), F.coalesce("t", F.lit(False)))))


def recent_scores(scores: DataFrame, n: int = 10_000, by: tuple[str, ...] = ("model_id", "version"), order: str = "seq") -> DataFrame:
    """The last n scores of each model version."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return scores.withColumn("_n", newest).where(F.col("_n") <= n).drop("_n")


def model_lifecycle(events: DataFrame) -> DataFrame:
    """Version numbers by registration, and the status that promotions leave: the last promoted is in production.

    events: (model_id, seq, action, version); action is register or promote.
    """
    registered = events.where("action = 'register'").withColumn("version", F.row_number().over(Window.partitionBy("model_id").orderBy("seq")))
    promoted = events.where("action = 'promote'").groupBy("model_id", "version").agg(F.max("seq").alias("promoted"))
    latest = F.max("promoted").over(Window.partitionBy("model_id"))
    status = F.when(F.col("promoted").isNull(), "staging").when(F.col("promoted") == F.col("latest"), "production").otherwise("retired")
    joined = registered.select("model_id", "version", F.col("seq").alias("registered")).join(promoted, ["model_id", "version"], "left")
    return joined.withColumn("latest", latest).select("model_id", "version", "registered", status.alias("status"))

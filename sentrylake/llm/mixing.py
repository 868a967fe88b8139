"""Mixing sources to target weights by capped water-filling.

A source's target is its share of the mixture by weight, clamped at
``max_epochs`` times its size; what is clamped off goes to the others in
proportion to their weights, until none is above its clamp.  The level of the
water has a closed form: order the sources by clamp over weight and clamp while
the level that the rest would reach is at or above the next clamp.

A source of size s and target t repeats every document floor(t / s) times, and
once more those that come first in a seeded order until the remainder of the
target is met to within half a document.  The order is cut into buckets by the
seeded hash, so the running sums of a source that holds a third of all rows
are spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents of a source that a task sums up in one group, on average.
BUCKET_ROWS = 10_000


def source_sizes(docs: DataFrame, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """(source, docs, size) of each source; null is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs"), F.coalesce(F.sum(size_col), F.lit(0)).alias("source_size"))


def ranked_weights(sizes: DataFrame, pattern: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``sizes`` and a weight: the pattern again and again over the sources by code point, null last.

    The sources are a table of one row each, for which somebody states
    weights; they are ordered in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*map(F.lit, pattern))
    return sizes.withColumn("weight", weights[F.pmod(rank, F.lit(len(pattern))).cast("int")])


def water_filling(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) and their targets.

    The targets sum to ``share`` times all sizes, or to all clamps where those
    are less.  A source of size or weight 0 gets 0.
    """
    clamp = F.col("source_size") * F.lit(float(max_epochs))
    by_level = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    none = sources.where("coalesce(weight, 0) <= 0").withColumn("target", F.lit(0.0))
    some = (
        sources.where("weight > 0")
        .withColumn("clamp", clamp)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        # the level at which the water stands if all sources before this one are clamped
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("is_free", F.col("level") * F.col("weight") < F.col("clamp"))
        .withColumn("water", F.min(F.when(F.col("is_free"), F.struct(F.col("clamp") / F.col("weight"), "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("water").isNull(), F.col("clamp")).otherwise(F.least(F.col("clamp"), F.col("water") * F.col("weight"))))
        .drop("clamp", "total", "level", "is_free", "water")
    )
    return some.unionByName(none)


def copies(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str,
    seed: int = 42,
    source_col: str = "source",
    size_col: str = "size",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` with source_size, target and copies: how often the mixture takes each row.

    docs: id_col, source_col, size_col and others; keep it narrow, its rows
    are shuffled.  targets: (source, docs, source_size, target), one row for
    each source.  No row is taken more than ceil(target / source_size) times.
    The order is that of md5(seed:id), ties by id and size; rows that agree in
    all three are interchangeable.  Rows of size 0 take whole repetitions only.
    Columns named source_size, target and copies are replaced, all others kept.
    An empty table gives an empty table.
    """
    docs = docs.drop("source_size", "target", "copies")
    # a row travels as one value, so that no column of it clashes with those of the work
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("s"), F.col(size_col).alias("size"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = (
        rows.join(targets.select("source", "docs", "source_size", "target"), F.col("s").eqNullSafe(F.col("source")))
        .withColumn("order", order)
        .withColumn("whole", F.floor(ratio))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        # the first 28 bits of the order, scaled to the number of buckets
        .withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28)) * F.ceil(F.col("docs") / F.lit(bucket_rows))))
    )
    sums = joined.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumn("run", F.sum("size").over(within)).join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    middle = F.col("base") + F.col("run") - F.col("size") / 2
    extra = (middle < F.col("rest")) & (F.col("size") > 0)
    return out.select("row.*", "source_size", "target", (F.col("whole") + extra.cast("long")).cast("long").alias("copies"))


def mix(
    docs: DataFrame,
    id_col: str,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: DataFrame | None = None,
    pattern: tuple[float, ...] = (5.0, 2.0, 1.0),
    seed: int = 42,
    source_col: str = "source",
    size_col: str = "size",
) -> DataFrame:
    """``docs`` with source_size, target and copies (see ``copies``).

    weights: (source, weight); a source that it lacks gets none.  Without it
    the pattern is dealt to the sources in order.  Null sizes count as 0, a
    null source is a source, a null id is an id, repeated rows are rows of their
    own, an empty table gives an empty table.  Only sizes of texts are used, so
    texts may be of any length.
    """
    docs = docs.withColumn(size_col, F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    sizes = source_sizes(docs, source_col, size_col)
    if weights is None:
        sizes = ranked_weights(sizes, pattern)
    else:
        given = weights.select(F.col("source").alias("_given"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("_given")), "left").drop("_given")
    return copies(docs, water_filling(sizes, share, max_epochs), id_col, seed, source_col, size_col)

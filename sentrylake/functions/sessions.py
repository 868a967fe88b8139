"""Sessions of a key by gaps in time, with a key's rows in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slices of time that a gap is cut into.
SLICES = 4


def sessionize(df: DataFrame, keys: list[str], gap: float, order: list[str], name: str = "session", slice_seconds: float | None = None, ends: Column | None = None) -> DataFrame:
    """``df`` with the number of each row's session in its key, from 1: a row goes on with the one before if it is at most ``gap`` seconds later.

    order: ``ts`` and what breaks its ties.  ends: true for a row that is the last of its session, whatever the gap.  A key's rows are counted in slices
    of time (``slice_seconds``, a quarter of the gap unless given), and a key
    only puts a row for each slice in one task, by which sessions go on over the
    slices' edges.  So a key that holds a third of all rows takes many
    tasks.  Rows without a time are one session, the first.
    """
    width = slice_seconds or gap / SLICES
    part, base, fresh, last = f"_{name}_slice", f"_{name}_base", f"_{name}_new", f"_{name}_last"
    over = F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False)
    rows = df.withColumn(part, F.floor(F.col("ts") / width).cast("long")).withColumn(last, over)
    within = Window.partitionBy(*keys, part).orderBy(*order)
    # the first row of a slice is judged by the slice before
    inner = ((F.col("ts") - F.lag("ts").over(within) > gap) | F.lag(last).over(within)).cast("long")
    rows = rows.withColumn(fresh, F.coalesce(inner, F.lit(0)))
    counts = rows.groupBy(*keys, part).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.sum(fresh).alias("more"), F.max_by(last, F.struct(*order)).alias("over"))
    slices = Window.partitionBy(*keys).orderBy(part)
    begins = F.when(F.lag("more").over(slices).isNull() | F.coalesce(F.col("lo") - F.lag("hi").over(slices) > gap, F.lit(True)) | F.lag("over").over(slices), 1).otherwise(0)
    counts = counts.withColumn("begins", begins)
    total = F.sum(F.col("begins") + F.col("more")).over(slices.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)), F.col(part).alias("_at"), (total - F.col("more")).alias(base))
    on = F.col(part).eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    running = F.sum(fresh).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(fresh, running).join(counts, on).withColumn(name, F.col(base) + F.col(fresh)).select(*(c for c in df.columns if c != name), name)

"""Exact order statistics: the value at a rank, without a sort and without a map of all values.

The range in which a rank lies is cut into bins of equal width, which are
counted in each task; the bin that holds the rank is the next range, from its
least to its greatest value.  When few values are left in it, or all are equal,
the rank is read off.  A round moves bins, not rows, however many different
values there are and however many rows one group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed

BINS = 1_024
#: Values that one task sorts to read a rank off.
SMALL = 10_000


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """A bin from 0 that does not fall as v grows; lo and hi have the first and the last one (infinite ends have one of their own)."""
    inside = F.nanvl((v - lo) / (hi - lo) * F.lit(float(bins)), F.lit(bins / 2))
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(inside)))).cast("int")


def values_at_ranks(df: DataFrame, by: list[str], value: str, ranks: DataFrame, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(by, rank, value) for each row of ``ranks`` (by, rank): the value at that place, from 0, among a group's values in order.

    Null and NaN values have no place; ranks beyond a group's values are left
    out.  A group is named by columns that are not null.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    found = ranks.select(*by, F.col("rank").cast("long").alias("rank")).distinct()
    found = found.join(ends, by) if by else found.crossJoin(F.broadcast(ends))
    # before: how many values lie below the range
    found = checkpointed(found.where("rank >= 0 and rank < n").withColumn("before", F.lit(0).cast("long")))
    key = [*by, "rank"]

    def within(ranges: DataFrame) -> DataFrame:
        """The values in each range; the ranges of a group come as one row."""
        of = ranges.groupBy(*by).agg(F.collect_list(F.struct("rank", "lo", "hi")).alias("ranges"))
        near = rows.join(of, by) if by else rows.crossJoin(F.broadcast(of))
        mine = F.filter("ranges", lambda r: (F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"]))
        return near.select(*by, "v", F.explode(mine).alias("r")).select(*by, "v", "r.*")

    while not (wide := found.where((F.col("n") > small) & (F.col("lo") < F.col("hi")))).isEmpty():
        counted = within(wide).groupBy(*key, _bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.withColumn("below", below).join(wide.select(*key, "before"), key)
        chosen = placed.where((F.col("rank") >= F.col("before") + F.col("below")) & (F.col("rank") < F.col("before") + F.col("below") + F.col("n")))
        done = found.join(wide.select(*key), key, "left_anti")
        found = checkpointed(done.unionByName(chosen.select(*key, "lo", "hi", "n", (F.col("before") + F.col("below")).alias("before"))))
    equal = found.where("lo = hi").select(*key, F.col("lo").alias("value"))
    few = found.where("lo < hi")
    order = Window.partitionBy(*key).orderBy("v")
    read = within(few).withColumn("place", F.row_number().over(order) - 1).join(few.select(*key, "before"), key).where(F.col("place") == F.col("rank") - F.col("before"))
    return equal.unionByName(read.select(*key, F.col("v").alias("value")))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(by, p): the interpolated percentiles of each group in the order of ``shares``; of each, the values at the two places around it."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("n"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("place")) for i, s in enumerate(shares))))
    places = checkpointed(counts.where("n > 0").select(*by, at.alias("a")).select(*by, "a.*").withColumn("low", F.floor("place")).withColumn("high", F.ceil("place")))
    ranks = places.select(*by, F.explode(F.array("low", "high")).alias("rank"))
    known = checkpointed(values_at_ranks(df, by, value, ranks, bins, small))
    low, high = (known.withColumnRenamed("rank", end).withColumnRenamed("value", f"at_{end}") for end in ("low", "high"))
    both = places.join(low, [*by, "low"]).join(high, [*by, "high"])
    part = F.col("place") - F.col("low")
    between = F.when(F.col("at_low") == F.col("at_high"), F.col("at_low")).otherwise(F.col("at_low") * (1 - part) + F.col("at_high") * part)
    return both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))), lambda x: x["v"]).alias("p"))

"""Sets of ids and pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_of_ids(tables: Sequence[DataFrame], columns: Sequence[str], name: str = "id") -> DataFrame:
    """The different values that stand in any of ``columns`` of any of ``tables``, without null; each table gives what it has."""
    ids = [df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns if c in df.columns))).alias(name)) for df in tables]
    return reduce(DataFrame.unionByName, ids).where(F.col(name).isNotNull()).distinct()


def confusion_of_ids(predicted: DataFrame, truth: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """(key, kind): tp, fp, fn or tn of each different id of the three sets; one pass over their union, an id each."""
    marks = {"p": predicted, "t": truth, "u": universe}
    rows = [df.select(key, *(F.lit(k == m).alias(m) for m in marks)) for k, df in marks.items()]
    one = reduce(DataFrame.unionByName, rows).groupBy(key).agg(*(F.bool_or(m).alias(m) for m in marks))
    kind = F.when(F.col("p") & F.col("t"), "tp").when(F.col("p"), "fp").when(F.col("t"), "fn").otherwise("tn")
    return one.select(key, kind.alias("kind"))


def distinct_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The different pairs of two columns, those with a null left out."""
    return rows.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()

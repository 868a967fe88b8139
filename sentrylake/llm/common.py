"""Columns that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once: a lambda's variable is."""
    return F.transform(F.array(value), of)[0]


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], part: int = 64) -> Column:
    """Array of ``op`` over all values up to and including each.

    A fold that grows its result copies it at each step; so each value folds
    its own part of the array, and what lies before the part is folded once.
    """

    def of(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(xs) - 1, F.lit(part))
        parts = F.transform(starts, lambda i: F.aggregate(F.slice(xs, i + 1, F.lit(part)), zero, op))

        def after(before: Column) -> Column:
            return F.transform(xs, lambda x, i: op(before[F.floor(i / part).cast("int")], F.aggregate(F.slice(xs, i - i % part + 1, i % part + 1), zero, op)))

        before = bound(parts, lambda p: F.transform(p, lambda x, i: F.aggregate(F.slice(p, F.lit(1), i), zero, op)))
        return F.when(F.size(xs) == 0, F.slice(F.array(zero), 1, 0)).otherwise(bound(before, after))

    return bound(values, of)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

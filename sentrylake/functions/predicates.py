"""Predicates as Columns: rule matchers and hunts.

Rule matchers are false on null.  Hunts are two-valued: a comparison with null is
false but for ``!=``, and negated membership and likeness are true on null.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _false_on_null(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


# --- rule matchers (F01-F07) ---------------------------------------------------------------------


def equals(text: str) -> Callable[[Column], Column]:
    """the same string but for case."""
    return lambda c: F.lower(c.cast("string")) == text.lower()


def regex(pattern: str) -> Callable[[Column], Column]:
    """the pattern is found anywhere, case ignored."""
    return lambda c: c.cast("string").rlike(f"(?i){pattern}")


def one_of(*values: Any) -> Callable[[Column], Column]:
    """one of the strings but for case."""
    return lambda c: F.lower(c.cast("string")).isin(*(str(v).lower() for v in values))


def compare(op: str, target: float) -> Callable[[Column], Column]:
    """a number compared; what is no number does not match."""
    ops = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "!=": "__ne__"}
    return lambda c: getattr(c.try_cast("double"), ops[op])(F.lit(float(target)))


def not_in(*values: Any) -> Callable[[Column], Column]:
    """none of the values; null does not match."""
    return lambda c: ~c.isin(*values)


def rule_matches(where: Mapping[str, Callable[[Column], Column]]) -> Column:
    """all matchers hold; a null field fails.  F06: a matcher under the empty name gets no field."""
    parts = [m(F.col(name)) if name else m() for name, m in where.items()]
    return _false_on_null(functools.reduce(Column.__and__, parts, F.lit(True)))


# --- structured selections (F18) -------------------------------------------------------------------


def selection(field: str, value: Any) -> Column:
    """One ``field|modifier: value`` pair; a list means any of its values, with ``all`` each of them."""
    name, *modifiers = field.split("|")
    values = [str(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    c = F.col(name).cast("string")
    quoted = [re.escape(v) for v in values]
    if "re" in modifiers:
        parts = [c.rlike(v) for v in values]
    elif "contains" in modifiers:
        parts = [c.rlike(f"(?i){q}") for q in quoted]
    elif "startswith" in modifiers:
        parts = [c.rlike(f"(?i)^{q}") for q in quoted]
    elif "endswith" in modifiers:
        parts = [c.rlike(f"(?i){q}$") for q in quoted]
    else:
        parts = [F.lower(c) == v.lower() for v in values]
    join = Column.__and__ if "all" in modifiers else Column.__or__
    return _false_on_null(functools.reduce(join, parts))


def selections(branches: Sequence[Mapping[str, Any]]) -> Column:
    """Any of the branches, each of whose pairs must all hold."""
    return functools.reduce(Column.__or__, (functools.reduce(Column.__and__, (selection(k, v) for k, v in b.items())) for b in branches))


# --- hunts (F09-F17) -------------------------------------------------------------------------------


def hunt_compare(a: Column, op: str, b: Any) -> Column:
    """``== != > >= < <=``; a number and a string that reads as one are compared as numbers."""
    numeric = isinstance(b, (int, float)) and not isinstance(b, bool)
    right = F.lit(b)
    left = a.try_cast("double") if numeric else a
    out = {"==": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    if op == "!=":
        # a value that does not read as a number differs from every number; null differs from all but null
        return F.coalesce(out, F.lit(b is not None) if not numeric else F.lit(True))
    return _false_on_null(out)


def hunt_and(*parts: Column) -> Column:
    return functools.reduce(Column.__and__, map(_false_on_null, parts))


def hunt_or(*parts: Column) -> Column:
    return functools.reduce(Column.__or__, map(_false_on_null, parts))


def hunt_not(p: Column) -> Column:
    return ~_false_on_null(p)


def hunt_in(c: Column, values: Sequence[Any], negate: bool = False) -> Column:
    """null is in no list, so ``NOT IN`` holds for it."""
    found = _false_on_null(c.isin(*values))
    return ~found if negate else found


def hunt_like(c: Column, pattern: str, negate: bool = False) -> Column:
    """``%`` and ``_``, case matters; on null the negation holds."""
    found = c.cast("string").like(pattern)
    return F.coalesce(~found if negate else found, F.lit(negate))


def hunt_regex(c: Column, pattern: str, negate: bool = False) -> Column:
    """found anywhere; on null the negation holds; a pattern that does not compile matches nothing."""
    try:
        re.compile(pattern)
        # Java's expressions run it, and some patterns compile in one language only
        SparkSession.active().sql("SELECT '' RLIKE ?", args=[pattern]).collect()
    except (re.error, PySparkException):
        return F.lit(False)
    found = c.cast("string").rlike(pattern)
    return F.coalesce(~found if negate else found, F.lit(negate))


def hunt_between(c: Column, low: Any, high: Any, negate: bool = False) -> Column:
    """any null gives false, also when negated."""
    found = c.between(F.lit(low), F.lit(high))
    return _false_on_null(~found if negate else found)


def hunt_exists(c: Column, negate: bool = False) -> Column:
    """IS [NOT] NULL."""
    return c.isNotNull() if negate else c.isNull()


def hunt(df: DataFrame, predicate: Column | str, max_matches: int | None = 1000, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """F16: the first matches in event order; predicate is a Column or a Spark SQL string."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    found = df.where(_false_on_null(p))
    return found if max_matches is None else found.orderBy(*order).limit(max_matches)


def run_hunts(df: DataFrame, hunts: Mapping[str, Column | str]) -> DataFrame:
    """(hunt_id, scanned, matched) of every hunt in one pass over the data."""
    columns = {k: _false_on_null(F.expr(p) if isinstance(p, str) else p) for k, p in hunts.items()}
    counts = df.agg(F.count("*").alias("scanned"), *(F.count_if(p).alias(k) for k, p in columns.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("hunt_id"), "scanned", F.col(k).alias("matched")) for k in columns))
    return counts.select(F.explode(rows).alias("r")).select("r.*")

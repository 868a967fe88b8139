"""Severities: text for people, rank for comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the least, and the scores from which they hold.
SEVERITIES = ("low", "medium", "high", "critical")
FLOORS = {"critical": 0.9, "high": 0.75, "medium": 0.5}


def severity_from_score(score: Column) -> Column:
    """Low below 0.5, medium below 0.75, high below 0.9, else critical; null for null."""
    out = F.when(score.isNotNull(), F.lit("low"))
    for name in ("medium", "high", "critical"):
        out = F.when(score >= FLOORS[name], F.lit(name)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """0 for low to 3 for critical; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)).cast("int") - 1


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def at_least(severity: Column, floor: str) -> Column:
    """true where the severity is the floor or above; false for null."""
    return F.coalesce(severity_rank(severity) >= SEVERITIES.index(floor), F.lit(False))

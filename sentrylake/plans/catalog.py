"""All registered queries and their SQL."""

from __future__ import annotations

from . import coverage_queries, detection_queries, file_queries, graph_queries, ingest_queries, model_queries, response_queries, stream_queries, trace_queries, triage_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "a04_detections_histogram"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

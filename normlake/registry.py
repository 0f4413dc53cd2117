"""All queries of the library proper and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .jobs import audit, bundles, checks, extraction, reports, retrieval, review, runtime, sessions, streams

_PARTS = (retrieval, checks, audit, review, extraction, sessions, streams, bundles, reports, runtime)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for part in _PARTS for k, q in part.ORACLES.items()}

"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 200_000


def is_small(df: DataFrame, most_rows: int = MOST_ROWS) -> bool:
    """Whether ``df`` has ``most_rows`` rows at most; stops counting there."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most_rows`` rows at most; beyond that Spark shuffles it."""
    return F.broadcast(df) if is_small(df, most_rows) else df

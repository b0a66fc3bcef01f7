"""Broadcast decisions that rest on a counted size, not on a guess."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEDULE_PAIRS = 200_000
HOSTS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when `df` has at most `max_rows` rows; beyond that the planner shuffles, and AQE splits hot keys.

    The count is a map-side aggregate over `df`; callers pass tables that are small or already written.
    """
    return F.broadcast(df) if df.count() <= max_rows else df

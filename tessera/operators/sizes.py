"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; above it joins are shuffled.
ROWS = 200_000


def small_side(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (rows + 1 are counted at most), else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

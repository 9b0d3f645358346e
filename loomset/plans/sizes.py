"""Plan choices that depend on a counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def spread_small(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """Spread a small table over the cores when the work per row is heavy.

    One row group is read by one task, so a small file keeps the other cores idle. The
    row count comes from file footers. A larger table has row groups enough and is
    returned as it is: it is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.count() <= limit else df


def distinct_at_most(df: DataFrame, column: str, limit: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether the column has at most ``limit`` distinct values (one combined count)."""
    return df.select(column).distinct().count() <= limit


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """The broadcast hint when the caller has checked the size, else the table as it is."""
    return F.broadcast(df) if small else df

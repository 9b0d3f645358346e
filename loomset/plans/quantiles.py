"""Exact linear-interpolated quantiles of columns of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def order_statistic(values: DataFrame, k: int, n: int, exact_rows: int) -> float:
    """The ``k``-th smallest (from 0) of the column ``x`` with ``n`` non-null rows.

    Each pass brackets the rank with a mergeable sketch, counts exactly on which
    side of the bracket the rank lies and keeps only the open interval around it.
    A value that repeats often is an end of the bracket and is answered at once,
    so ties do not stall. Every pass returns one row to the driver and
    keeps about 4 in 10,000 rows; the last one sorts at most ``exact_rows`` values.
    """
    below, inside, slack = 0, n, 2.0 / ACCURACY
    current = values
    while inside > exact_rows:
        rank = k - below
        at = (rank + 0.5) / inside
        ends = [max(at - slack, 0.0), min(at + slack, 1.0)]
        a, b = current.agg(F.percentile_approx("x", ends, ACCURACY)).first()[0]
        lt_a, le_a, lt_b, le_b = current.agg(
            F.count_if(F.col("x") < a), F.count_if(F.col("x") <= a),
            F.count_if(F.col("x") < b), F.count_if(F.col("x") <= b),
        ).first()
        if rank < lt_a:
            current, inside = current.where(F.col("x") < a), lt_a
        elif rank < le_a:
            return a
        elif rank < lt_b:
            current = current.where((F.col("x") > a) & (F.col("x") < b))
            below, inside = below + le_a, lt_b - le_a
        elif rank < le_b:
            return b
        else:
            current = current.where(F.col("x") > b)
            below, inside = below + le_b, inside - le_b
    ordered = F.sort_array(F.collect_list("x"))
    return current.agg(F.get(ordered, F.lit(k - below))).first()[0]


def exact_quantile(
    df: DataFrame, column: str, q: float, name: str = "quantile", exact_rows: int = 200_000
) -> DataFrame:
    """One row with the ``q`` quantile; null and NaN are missing, no values give null.

    Up to ``exact_rows`` rows this is the built-in ``percentile``, which keeps every
    distinct value in one task. Beyond that the two neighbouring order statistics
    are searched, which runs a few small jobs when the plan is built.
    """
    values = df.select(F.nullif(F.col(column).cast("double"), F.lit(math.nan)).alias("x"))
    if df.count() <= exact_rows:
        return values.agg(F.percentile("x", F.lit(q)).alias(name))
    n = values.agg(F.count("x")).first()[0]
    if n == 0:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias(name))
    position = (n - 1) * q
    k = math.floor(position)
    low = order_statistic(values, k, n, exact_rows)
    if position == k:
        high = low
    else:
        seen, above = values.agg(
            F.count_if(F.col("x") <= low), F.min(F.when(F.col("x") > low, F.col("x")))
        ).first()
        high = low if k + 1 < seen else above
    answer = low + (high - low) * (position - k)
    return df.sparkSession.range(1).select(F.lit(answer).alias(name))

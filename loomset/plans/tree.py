"""Sums of wide vectors that tasks have added up, in two steps so that no task meets all of them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCHES = 256


def sum_vectors(parts: DataFrame, vector: str, by: Sequence[str] = (), branches: int = BRANCHES) -> DataFrame:
    """``(*by, vector)``: the element-wise sum of equally long arrays of BIGINT or DOUBLE; no rows, no sum.

    Meant for one row a task and key. The rows go to ``branches`` places by the number of their
    task, and what those add up to meets at the end. Whole numbers stay exact.
    """
    keys = list(by)
    rows = parts.select(*keys, vector, (F.spark_partition_id() % branches).alias("_branch"))

    def add(table: pa.Table) -> pa.Table:
        vectors = table.column(vector).combine_chunks()
        total = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).sum(axis=0)
        ends = pa.array([0, len(total)], pa.int32())
        one = pa.ListArray.from_arrays(ends, pa.array(total))
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index(vector), vector, one)

    for names in ([*keys, "_branch"], keys):
        shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*names, vector])
        rows = rows.select(*names, vector).groupBy(*names).applyInArrow(add, shape)
    return rows.select(*keys, vector)

"""All pairs of two class tables as an equi-join on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_parts: int = 4, right_parts: int = 4
) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``.

    Meant for tables over classes, where the pairs are the answer itself. The left
    side is cut into ``left_parts`` fragments and copied ``right_parts`` times, the
    right side the other way round, so the pairs are spread evenly over
    ``left_parts * right_parts`` join keys; no side is broadcast and no task sees a
    whole table.
    """

    def fragment(key: str, parts: int):
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def copies(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    rows = left.withColumn("_row", fragment(left_key, left_parts)).withColumn("_col", copies(right_parts))
    cols = right.withColumn("_col", fragment(right_key, right_parts)).withColumn("_row", copies(left_parts))
    return rows.join(cols, ["_row", "_col"]).drop("_row", "_col")

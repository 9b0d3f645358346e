"""Seeded row order, exact cut-offs and global numbering.

Rows are ordered by ``md5(seed:id)`` and then by id. The order is a pure function
of the seed and the id, so a task that is run again after a lost executor makes
the same choice. ``id`` must be unique.

Nothing here sorts a whole table in one task. The first four hex digits of the key
cut the rows into 65,536 even buckets (the key is a hash, so hot values of other
columns cannot make a bucket hot). Bucket counts are combined on the map side
and give every bucket its global offset.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.plans.sizes import broadcast_if

PREFIX_DIGITS = 4


def hash_key(id_col: str | Column, seed: int) -> Column:
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def _bucket(key: Column) -> Column:
    # Never null, so that no join asks for a null check that hashes the id again.
    return F.coalesce(F.left(key, F.lit(PREFIX_DIGITS)), F.lit(""))


def order_key(id_col: str, seed: int) -> Column:
    """The comparable row key ``(hash, id)``."""
    return F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("i"))


def cut_keys(
    df: DataFrame,
    id_col: str,
    seed: int,
    cuts: Callable[[DataFrame], DataFrame],
    group: Sequence[str] = (),
    few_groups: bool = True,
) -> DataFrame:
    """Row key at given ranks, per group: ``(*group, part, key)``.

    ``cuts`` receives the bucket counts with a ``total`` column (rows of the group)
    and adds ``cuts ARRAY<STRUCT<part, k>>``: the 1-based ranks to look up. Only
    the rows of the buckets that hold a wanted rank (about 1 in 65,536) are ranked.
    A rank of 0 or beyond the group yields no row. The wanted ranks, a few per group,
    are broadcast unless the caller found too many groups.
    """
    group = list(group)
    keyed = df.select(*group, order_key(id_col, seed).alias("key")).withColumn(
        "bucket", _bucket(F.col("key.h"))
    )
    counts = keyed.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most 65,536 rows per window partition, whatever the size of the table.
    within = Window.partitionBy(*group)
    running = counts.select(
        *group,
        "bucket",
        F.sum("n").over(within.orderBy("bucket")).alias("last"),
        "n",
        F.sum("n").over(within).alias("total"),
    ).withColumn("first", F.col("last") - F.col("n"))
    wanted = (
        cuts(running)
        .withColumn(
            "cut",
            F.explode(F.filter("cuts", lambda c: (c["k"] > F.col("first")) & (c["k"] <= F.col("last")))),
        )
        .select(*group, "bucket", F.col("cut.part").alias("part"), (F.col("cut.k") - F.col("first")).alias("pos"))
    )
    inside = keyed.join(broadcast_if(few_groups, wanted), [*group, "bucket"])
    place = F.row_number().over(Window.partitionBy(*group, "part").orderBy("key"))
    return inside.withColumn("place", place).where("place = pos").select(*group, "part", "key")


def assign_parts(
    df: DataFrame,
    id_col: str,
    ends: Callable[[Column], Sequence[tuple[str, Column]]],
    last: str,
    seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Label every row with the part its rank falls in, without moving a row.

    ``ends(n)`` lists ``(part, end_rank)`` in rising order for a table of ``n`` rows;
    rows behind the last end are ``last``. The cut keys are scalar subqueries, so
    the labelling itself is a projection over the scan.
    """

    def with_cuts(running: DataFrame) -> DataFrame:
        wanted = [
            F.struct(F.lit(part).alias("part"), end.cast("bigint").alias("k"))
            for part, end in ends(F.col("total"))
        ]
        return running.withColumn("cuts", F.array(*wanted))

    keys = cut_keys(df, id_col, seed, with_cuts)
    found = keys.agg(F.map_from_entries(F.collect_list(F.struct("part", "key"))).alias("m")).scalar()
    label = F.lit(last)
    for part, _ in reversed(ends(F.lit(0))):
        reached = order_key(id_col, seed) <= F.try_element_at(found, F.lit(part))
        label = F.when(reached, F.lit(part)).otherwise(label)
    return df.withColumn(name, label)


def hash_rank(df: DataFrame, id_col: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """1-based position of every row in the seeded order (one shuffle, by bucket)."""
    keyed = df.withColumn("_key", order_key(id_col, seed)).withColumn("_bucket", _bucket(F.col("_key.h")))
    counts = (
        df.select(_bucket(hash_key(id_col, seed)).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    running = F.sum("_n").over(Window.orderBy("_bucket"))  # at most 65,536 rows
    offsets = counts.select("_bucket", (running - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    return (
        keyed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bucket")  # at most 65,536 rows of two columns
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_key", "_bucket", "_place", "_before")
    )


def global_index(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row in the order of ``order_by``.

    A range-partitioned sort followed by the distributed sequence index of
    pandas-on-Spark: partition sizes are counted first, then every partition
    numbers its own rows.
    """
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    return df.orderBy(*order_by).pandas_api().to_spark(index_col=name)

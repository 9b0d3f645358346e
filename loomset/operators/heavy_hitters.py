"""Exact top counts from summaries of bounded size.

Each task keeps a summary of the items it sees and how much it may have missed. The merged summaries
name the candidates, those are counted exactly, and a comparison with the missed amount proves
that no other item can win. Groups where it does not prove that are counted in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.corpus import top_per_group
from loomset.plans.sizes import MAX_BROADCAST_ROWS, broadcast_if
from loomset.sources.storage import stored

#: Items of one group that a summary keeps when it is cut.
CAPACITY = 50_000


class _Summary:
    """Counts of the items of a group, cut to the largest; ``missed`` bounds what any item has lost."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.missed = capacity, 0
        self.counts: Counter[str] = Counter()

    def add(self, items: list[str]) -> None:
        self.counts.update(items)
        if len(self.counts) > 2 * self.capacity:
            kept = self.counts.most_common(self.capacity + 1)
            self.missed += kept[-1][1]
            self.counts = Counter(dict(kept[:-1]))


def _summarise(group_type: pa.DataType, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, _Summary] = {}
        for batch in batches:
            for group, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if items:
                    held.setdefault(group, _Summary(capacity)).add([x for x in items if x is not None])
        for group, summary in held.items():
            pairs = [(None, summary.missed), *summary.counts.items()]
            for at in range(0, len(pairs), 50_000):
                some = pairs[at : at + 50_000]
                columns = [pa.array([group] * len(some), group_type), pa.array([p[0] for p in some], pa.string()), pa.array([p[1] for p in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "item", "n"])

    return run


def top_counts(df: DataFrame, group: str, items: Column, name: str, k: int = 5, capacity: int = CAPACITY) -> DataFrame:
    """``(group, name, n, rank)``: the ``k`` most frequent items per group, exactly; ties go to the smaller item.

    ``items`` is an array of strings per row; null items and null arrays count nothing, a null group is a group. A task
    sends at most ``2 * capacity`` items a group, and the exact count only candidates, instead of every
    different item it has seen. The items are computed once and stored.
    """
    rows = stored(df.select(F.col(group).alias("grp"), items.cast("array<string>").alias("items")), "items")
    kind = rows.schema["grp"].dataType
    parts = stored(rows.mapInArrow(_summarise(rows.limit(0).select("grp").toArrow().schema.field("grp").type, capacity),
                                   f"grp {kind.simpleString()}, item STRING, n BIGINT"), "summaries")
    missed = parts.where("item IS NULL").groupBy("grp").agg(F.sum("n").alias("missed"))
    least = stored(parts.where("item IS NOT NULL").groupBy("grp", "item").agg(F.sum("n").alias("least")), "least-counts")
    kth = top_per_group(least, "grp", [F.desc("least"), F.asc("item")], k).groupBy("grp").agg(F.min("least").alias("kth"))
    bounds = missed.join(kth, missed["grp"].eqNullSafe(kth["grp"])).select(missed["grp"].alias("of"), "missed", "kth")
    bounds = stored(bounds, "bounds")  # one row a group
    near = least.join(bounds, F.col("grp").eqNullSafe(F.col("of"))).where(F.col("least") + F.col("missed") >= F.col("kth"))
    candidates = stored(near.select("of", F.col("item").alias("candidate"), "missed"), "candidates")
    few = candidates.count() <= MAX_BROADCAST_ROWS
    seen = rows.select("grp", F.explode("items").alias("item")).where("item IS NOT NULL")
    same = F.col("grp").eqNullSafe(F.col("of")) & (F.col("item") == F.col("candidate"))
    exact = seen.join(broadcast_if(few, candidates), same).groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n"), F.first("missed").alias("missed"))
    best = stored(top_per_group(exact, "grp", [F.desc("n"), F.asc("item")], k), "best")
    # Proven where nothing was missed, or where the last of k is larger than all that any other item can have.
    proof = best.groupBy("grp").agg(((F.max("missed") == 0) | (F.max("rank") == k) & (F.min("n") > F.max("missed"))).alias("proven"))
    proof = stored(proof.select(F.col("grp").alias("of"), "proven"), "proofs")
    open_groups = proof.where("NOT proven")
    proven = best.join(proof.where("proven"), F.col("grp").eqNullSafe(F.col("of")), "left_semi").select("grp", "item", "n", "rank")
    if open_groups.limit(1).count():
        left = seen.join(open_groups, F.col("grp").eqNullSafe(F.col("of")), "left_semi").groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n"))
        proven = proven.unionByName(top_per_group(left, "grp", [F.desc("n"), F.asc("item")], k))
    return proven.select(F.col("grp").alias(group), F.col("item").alias(name), "n", "rank")

"""A uniform shuffle of rows into shards whose sizes are exact.

How many rows go from each partition to each shard is drawn first, as one matrix with
fixed sums of rows and columns (multivariate hypergeometric). Then every partition is permuted on its
own and dealt out by the matrix, the rows change places, and every shard is permuted again.

A partition is a file of the table. Permutations are keyed swap-or-not shuffles (Hoang, Morris
and Rogaway, 2012): the place of a row follows from its number alone, so that no task
holds a partition or a shard, and a task that runs again puts its rows in the same places.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.shingles import ODD, mix
from loomset.llm.workers import share
from loomset.plans.sizes import MAX_BROADCAST_ROWS, broadcast_if
from loomset.sources.late_fetch import FILE, ROW, with_places
from loomset.sources.storage import stored

SHARDS = 24
#: Groups of files; their counts are the only ones that the driver sees.
BLOCKS = 1024
ROUNDS = 96


def hypergeometric(u: float, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good + bad`` are good, by inversion at ``u`` in [0, 1).

    The weights are followed from the mode to 14 standard deviations and 30 more, beyond
    which less is left than a double can hold; counts may have any size.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    whole = good + bad
    mode = (n + 1) * (good + 1) // (whole + 2)
    spread = math.sqrt(n * (good / whole) * (bad / whole) * ((whole - n) / (whole - 1)))
    reach = int(14 * spread) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    weights = np.concatenate(([0.0], np.cumsum(steps)))
    sums = np.cumsum(np.exp(weights - weights.max()))
    return low + min(int(np.searchsorted(sums, u * sums[-1], side="right")), high - low)


def communication_matrix(rows: list[int], columns: list[int], rng: np.random.Generator) -> np.ndarray:
    """Counts with these sums of rows and columns, as a uniform shuffle would have them."""
    left, drawn = list(columns), np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j, u in enumerate(rng.random(len(left))):
            rest -= left[j]
            drawn[i, j] = hypergeometric(u, left[j], rest, n)
            n -= int(drawn[i, j])
            left[j] -= int(drawn[i, j])
    return drawn


def permuted(place: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a permutation of ``range(size)`` that depends on ``key`` takes each place."""
    x, size = place.astype(np.uint64), size.astype(np.uint64)
    for step in np.arange(1, ROUNDS + 1, dtype=np.uint64) * ODD:
        turn = mix(key + step)
        partner = (turn % size + size - x) % size
        swap = mix(np.maximum(x, partner) * ODD ^ turn) >> np.uint64(63)
        x = np.where(swap == 1, partner, x)
    return x.astype(np.int64)


def shard_sizes(n: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards have the rows that are over."""
    return [n // shards + (j < n % shards) for j in range(shards)]


def block(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BLOCKS)).cast("int")


def file_matrix(files: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """((file, key, n, counts, before), rows) for the files (file, n): what each sends to each shard, and after how many others.

    The matrix of blocks of files is drawn by the driver, from at most ``BLOCKS`` numbers; the rows
    of a block are drawn in a task.
    """
    files = stored(files.withColumn("block", block(FILE)), "file-counts")
    found = files.groupBy("block").agg(F.sum("n")).orderBy("block").collect()
    sizes, rows = [int(r[1]) for r in found], sum(int(r[1]) for r in found)
    drawn = communication_matrix(sizes, shard_sizes(rows, shards), np.random.default_rng([seed, 1]))
    before = np.cumsum(drawn, axis=0) - drawn
    get = share(files.sparkSession, {r[0]: (drawn[i], before[i]) for i, r in enumerate(found)})

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FILE)
        number = int(part["block"].iloc[0])
        columns, first = get()[number]
        counts = communication_matrix([int(n) for n in part["n"]], [int(c) for c in columns], np.random.default_rng([seed, 2, number]))
        ahead = first + np.cumsum(counts, axis=0) - counts
        key = (np.int64(number) << 40) + np.arange(len(part))
        return pd.DataFrame({FILE: part[FILE], "key": key, "n": part["n"], "counts": list(counts), "before": list(ahead)})

    schema = f"{FILE} string, key long, n long, counts array<long>, before array<long>"
    return stored(files.groupBy("block").applyInPandas(draw, schema), "shard-counts"), rows


def places(shards: int, rows: int, seed: int):
    """A column function that gives the shard and the slot of a row from its number and its file's counts."""
    sizes = np.array(shard_sizes(rows, shards), np.int64)
    seeds = mix(np.array([seed, seed ^ 0x5BD1E995], np.uint64) * ODD)

    @F.arrow_udf("struct<shard: int, slot: long>")
    def place(row: pa.Array, n: pa.Array, key: pa.Array, counts: pa.Array, before: pa.Array) -> pa.Array:
        sent = counts.flatten().to_numpy().reshape(-1, shards)
        ahead = before.flatten().to_numpy().reshape(-1, shards)
        local = permuted(row.to_numpy(), n.to_numpy(), mix(key.to_numpy().astype(np.uint64) ^ seeds[0]))
        ends = np.cumsum(sent, axis=1)
        shard = (local[:, None] >= ends).sum(axis=1)
        at = np.arange(len(shard))
        received = ahead[at, shard] + local - ends[at, shard] + sent[at, shard]
        slot = permuted(received, sizes[shard], mix(shard.astype(np.uint64) ^ seeds[1]))
        return pa.StructArray.from_arrays([pa.array(shard.astype(np.int32)), pa.array(slot)], ["shard", "slot"])

    return place


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> tuple[DataFrame, int]:
    """(the rows of ``docs`` with ``shard`` and ``slot``, their number); no row moves. See ``shuffle``."""
    rows = with_places(docs)
    matrix, n = file_matrix(rows.groupBy(FILE).agg(F.count(F.lit(1)).alias("n")), shards, seed)
    counted = [F.col(c).alias(f"_loomset_{c}") for c in ("n", "key", "counts", "before")]
    few = matrix.count() <= MAX_BROADCAST_ROWS  # two counts a shard and a path each
    joined = rows.join(broadcast_if(few, matrix.select(FILE, *counted)), FILE)
    found = places(shards, n, seed)(*[F.col(c) for c in (ROW, "_loomset_n", "_loomset_key", "_loomset_counts", "_loomset_before")])
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    placed = joined.select(*kept, found.alias("_loomset_place"))
    return placed.select(*kept, "_loomset_place.shard", "_loomset_place.slot"), n


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """All rows of ``docs`` in random order over ``shards`` shards, whose counts are at most one apart.

    Adds ``shard`` and ``slot``, the place in the shard without gaps from 0; columns of these
    names are replaced. Every order of the rows is meant to be equally likely, whatever
    they hold: nulls, empty or very long texts, and rows that repeat others, which are dealt out each.
    Fewer rows than shards leave the last shards empty, and an empty table stays empty.

    The result comes in order of shard and slot, in partitions of one size, so shards can be
    written as they stand. The same files and seed give the same places. A table that is more than
    a choice of columns of Parquet files is written to the shared folder first.
    """
    placed, n = assign(docs, shards, seed)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least, over = divmod(n, shards)
    ahead = F.col("shard") * F.lit(least) + F.least(F.col("shard"), F.lit(over)) + F.col("slot")
    target = F.floor(ahead / F.lit(max(n, 1)) * F.lit(parts)).cast("int")
    return placed.repartitionById(parts, F.least(target, F.lit(parts - 1))).sortWithinPartitions("shard", "slot")

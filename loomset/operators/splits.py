"""Exact-size seeded splits, samples and batches.

Same seed, same rows, on any cluster and after any retry. ``id`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.plans.ranking import assign_parts, cut_keys, global_index, hash_rank, order_key
from loomset.plans.sizes import broadcast_if, distinct_at_most
from loomset.sources.storage import stored

#: Ranges of remainders that one search step counts.
REMAINDER_RANGES = 4096


def _share(fraction: float, n: Column) -> Column:
    return F.lit(float(fraction)) * n.cast("double")


def _train_rows(n: Column, held_out: float) -> Column:
    return n - F.ceil(_share(held_out, n))


def split_train_val_test(df: DataFrame, id_col: str, seed: int = 42, held_out: float = 0.2) -> DataFrame:
    """80/10/10: ``ceil(0.2 n)`` rows are held out, ``ceil(m / 2)`` of those are test."""

    def ends(n: Column):
        train = _train_rows(n, held_out)
        held = n - train
        return [("train", train), ("val", n - F.ceil(_share(0.5, held)))]

    return assign_parts(df, id_col, ends, last="test", seed=seed)


def split_train_val(df: DataFrame, id_col: str, seed: int = 42, train: float = 0.9) -> DataFrame:
    """``int(0.9 n)`` training rows, the rest validation."""
    return assign_parts(df, id_col, lambda n: [("train", F.floor(_share(train, n)))], last="val", seed=seed)


def split_held_out(df: DataFrame, id_col: str, seed: int = 42, held_out: float = 0.2) -> DataFrame:
    """80/20: ``ceil(0.2 n)`` validation rows."""
    return assign_parts(df, id_col, lambda n: [("train", _train_rows(n, held_out))], last="val", seed=seed)


def few_shot_sample(
    df: DataFrame, id_col: str, fraction: float = 0.05, seed: int = 42, held_out: float = 0.2
) -> DataFrame:
    """``round(0.05 t)`` rows of the ``t`` training rows of the 80/20 split."""

    def ends(n: Column):
        return [("few_shot", F.bround(_share(fraction, _train_rows(n, held_out)), 0))]

    return assign_parts(df, id_col, ends, last="rest", seed=seed).where("split = 'few_shot'").drop("split")


def fixed_size_sample(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """``min(size, n)`` rows, the same for every caller with this seed."""

    def ends(n: Column):
        return [("sample", F.least(F.lit(size).cast("bigint"), n))]

    return assign_parts(df, id_col, ends, last="rest", seed=seed).where("split = 'sample'").drop("split")


def _first_labels(tied: DataFrame, label: str, k: int) -> DataFrame:
    """The ``k`` smallest labels, one row each, numbered in sorted ranges."""
    numbered = global_index(tied.select(F.col(label).alias("_label")), ["_label"], "_place")
    return numbered.where(F.col("_place") < k).select("_label", F.lit(1).alias("_tied"))


def _quotas(df: DataFrame, label: str, size: int) -> DataFrame:
    """Rows to take per label, by largest remainder; ties go to the smaller label.

    Remainders are whole numbers (``n * size`` modulo the number of rows). The least one that
    still gets a place is searched by counts of labels in ever narrower ranges, and only labels with
    exactly that remainder are put in order, so no task sees all labels.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("wanted", F.col("n").cast("decimal(20,0)") * F.lit(size).cast("decimal(18,0)")), "label-counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    whole = F.lit(max(rows, 1)).cast("decimal(20,0)")
    parts = counts.select(
        label, "n", F.call_function("div", F.col("wanted"), whole).alias("base"),
        (F.col("wanted") % whole).cast("bigint").alias("left"),
    )
    given = parts.agg(F.sum("base")).first()[0] or 0
    places = min(size, rows) - given
    low, high = 0, max(rows, 1)  # the last label with a place has a remainder in [low, high)
    above = 0
    while high - low > 1:
        step = -(-(high - low) // REMAINDER_RANGES)
        inside = parts.where((F.col("left") >= low) & (F.col("left") < high))
        ranges = inside.groupBy(F.floor((F.col("left") - low) / F.lit(step)).alias("r")).agg(F.count(F.lit(1)).alias("k"))
        for r, k in sorted(map(tuple, ranges.collect()), reverse=True):
            if above + k >= places:
                low, high = low + r * step, min(low + (r + 1) * step, high)
                break
            above += k
        else:
            break
    tied = _first_labels(parts.where(F.col("left") == low), label, places - above)
    more = F.when(F.col("left") > low, 1).otherwise(F.coalesce("_tied", F.lit(0)))
    return parts.join(tied, F.col(label).eqNullSafe(F.col("_label")), "left").select(label, F.least(F.col("base") + more, F.col("n")).cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, id_col: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows, proportional per label.

    Each label has one cut key; rows up to it are kept. A label that holds most
    rows is ranked only inside the one hash bucket where its quota ends. With a
    counted, small number of labels the cut keys are broadcast and no row moves.
    """
    few = distinct_at_most(df, label)
    quotas = _quotas(df, label, size)

    def with_cuts(running: DataFrame) -> DataFrame:
        wanted = F.array(F.struct(F.lit("sample").alias("part"), F.col("quota").alias("k")))
        return running.join(quotas, label).withColumn("cuts", wanted).drop("quota")

    keys = cut_keys(df, id_col, seed, with_cuts, [label], few).select(label, F.col("key").alias("_cut"))
    return df.join(broadcast_if(few, keys), label).where(order_key(id_col, seed) <= F.col("_cut")).drop("_cut")


def shuffle_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 42) -> DataFrame:
    """Add ``batch_id``: shuffled batches of ``batch_size``, the last one may be short."""
    ranked = hash_rank(df, id_col, seed, "_rank")
    return ranked.withColumn("batch_id", F.floor((F.col("_rank") - 1) / batch_size).cast("bigint")).drop("_rank")

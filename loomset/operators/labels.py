"""Multi-label tables: classes, multi-hot vectors, counts, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.plans.pairs import grid_pairs


def split_rejects(df: DataFrame, id_col: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and ``(id, reason)`` of the rows that fail a check.

    A check that evaluates to null counts as failed; the first failing check names
    the reason, and the run goes on.
    """
    reason = F.lit(None).cast("string")
    for name, check in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(check, F.lit(False)), F.lit(name)).otherwise(reason)
    marked = df.withColumn("reason", reason)
    good = marked.where("reason IS NULL").drop("reason")
    return good, marked.where("reason IS NOT NULL").select(id_col, "reason")


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """Occurrences per label, most first; a label repeated in a row counts each time."""
    return (
        df.select(F.explode(labels).alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def label_cardinality_distribution(df: DataFrame, labels: str) -> DataFrame:
    return (
        df.groupBy(F.size(labels).alias("num_labels")).agg(F.count(F.lit(1)).alias("n")).orderBy("num_labels")
    )


def label_summary(df: DataFrame, labels: str) -> DataFrame:
    """Row count, distinct labels, mean labels per row, in one row."""
    distinct = df.select(F.explode(labels).alias("label")).agg(F.count_distinct("label")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.size(labels)).alias("mean_labels")
    ).select("n_rows", distinct.alias("n_labels"), "mean_labels")


def fit_classes(df: DataFrame, labels: str) -> DataFrame:
    """One row with the sorted distinct labels, as wide as a multi-hot vector."""
    distinct = df.select(F.explode(labels).alias("label")).distinct()
    return distinct.agg(F.sort_array(F.collect_list("label")).alias("classes"))


def multi_hot(df: DataFrame, labels: str, classes: DataFrame, output: str = "labels_binary") -> DataFrame:
    """Add a 0/1 vector over ``classes``; repeats collapse, unknown labels are ignored."""
    known = df.withColumn("_classes", classes.select("classes").scalar())
    hot = F.transform("_classes", lambda c: F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("int"))
    return known.withColumn(output, hot).drop("_classes")


def label_cooccurrence(df: DataFrame, labels: str) -> DataFrame:
    """``(a, b, n_ab)`` for label pairs that share a row; ``a = b`` is the label count.

    Each row adds its own unordered pairs to counters that live in the task, so the
    shuffle carries class pairs, not rows. The mirrored half is added at the end.
    """
    distinct = F.array_sort(F.array_distinct(labels))
    pairs = F.flatten(
        F.transform(
            distinct,
            lambda a, i: F.transform(
                F.slice(distinct, i + 1, F.size(distinct)), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    upper = df.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return upper.select(F.explode(F.array_distinct(both)).alias("p"), "n_ab").select("p.a", "p.b", "n_ab")


def label_correlation(df: DataFrame, labels: str) -> DataFrame:
    """Pearson correlation of the 0/1 label columns over all class pairs.

    Closed form over the pair counts. A label that every row has is constant and
    gives null.
    """
    counts = label_cooccurrence(df, labels)
    single = (
        df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    )
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    left = single.select(F.col("label").alias("a"), F.col("n").alias("n_a"))
    right = single.select(F.col("label").alias("b"), F.col("n").alias("n_b"))
    grid = grid_pairs(left, right, "a", "b").join(counts, ["a", "b"], "left").withColumn("n", n)
    n_ab = F.coalesce("n_ab", F.lit(0))
    spread = F.col("n_a") * (F.col("n") - F.col("n_a")) * (F.col("n_b") * (F.col("n") - F.col("n_b")))
    value = F.try_divide(F.col("n") * n_ab - F.col("n_a") * F.col("n_b"), F.sqrt(spread))
    return grid.select("a", "b", value.alias("correlation"))

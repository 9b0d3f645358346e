"""Evaluation of single-label, multi-label and per-epoch results.

Multi-label predictions are rows with two 0/1 arrays in class order (``y_true``,
``y_pred``), so a row's own checks need no shuffle, and class counters are
combined inside each task: the shuffle carries (classes x tasks) rows.
Undefined scores are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.vectors import bce_with_logits, log_sum_exp
from loomset.operators.corpus import top_per_group
from loomset.plans.pairs import grid_pairs


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


# --- single label -----------------------------------------------------------------


def _pair_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """``(y_true, y_pred, n)`` over the union of both label sets, zero cells included."""
    counts = _pair_counts(df, y_true, y_pred)
    # The count is kept up to here so that both uses share one shuffle of the pairs.
    both = counts.select(F.explode(F.array("y_true", "y_pred")).alias("y_true"), "n")
    seen = both.groupBy("y_true").agg(F.sum("n").alias("rows")).where("rows > 0").select("y_true")
    grid = grid_pairs(seen, seen.withColumnRenamed("y_true", "y_pred"), "y_true", "y_pred")
    # Zero cells are added up with the counts. A join would ask for labels that are not
    # null, and Spark would score the rows a second time to check.
    empty = grid.select("y_true", "y_pred", F.lit(0).cast("bigint").alias("n"))
    return empty.unionByName(counts).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def class_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """``(label, tp, fp, fn)`` from the pair counts."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("bigint")
    n = F.col("n")
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"), (n * hit).alias("tp"), (n * 0).alias("fp"), (n * (1 - hit)).alias("fn")
        ),
        F.struct(
            F.col("y_pred").alias("label"), (n * 0).alias("tp"), (n * (1 - hit)).alias("fp"), (n * 0).alias("fn")
        ),
    )
    return (
        _pair_counts(df, y_true, y_pred)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


def errors_per_class(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Missed (``fn``) and wrongly predicted (``fp``) rows per class."""
    return class_counts(df, y_true, y_pred).select("label", "fn", "fp").orderBy("label")


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("int")).alias("accuracy"))


def single_label_f1(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row ``(f1_micro, f1_macro)``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_counts(df, y_true, y_pred).agg(
        f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("f1_micro"), F.avg(f1(tp, fp, fn)).alias("f1_macro")
    )


# --- multi label ------------------------------------------------------------------


def cell_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, pos, tp, fp, fn, n, exact)`` per class position.

    ``exact`` counts the rows whose whole vector matches; it is the same for every
    position, because every row has a cell at each.
    """
    same = (F.col("y_true") == F.col("y_pred")).cast("int").alias("same")
    cells = df.select(*by, same, F.posexplode(F.arrays_zip("y_true", "y_pred")).alias("pos", "c"))
    t, p = F.col("c.y_true"), F.col("c.y_pred")
    return cells.groupBy(*by, "pos").agg(
        F.sum(t * p).alias("tp"),
        F.sum((1 - t) * p).alias("fp"),
        F.sum(t * (1 - p)).alias("fn"),
        F.count(F.lit(1)).alias("n"),
        F.sum("same").alias("exact"),
    )


def multilabel_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, micro_f1, macro_f1, subset_acc, hamming_acc)`` in one pass over the rows."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cell_counts(df, by).groupBy(*by).agg(
        f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("micro_f1"),
        F.avg(f1(tp, fp, fn)).alias("macro_f1"),
        ratio(F.sum("exact"), F.sum("n")).alias("subset_acc"),
        (1.0 - ratio(F.sum(fp + fn), F.sum("n"))).alias("hamming_acc"),
    )


def micro_f1(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return cell_counts(df).agg(f1(tp, fp, fn).alias("micro_f1"))


def macro_f1(df: DataFrame) -> DataFrame:
    return cell_counts(df).agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))


def subset_accuracy(df: DataFrame) -> DataFrame:
    """Share of rows whose whole vector matches: a row-local check."""
    return df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("subset_acc"))


def hamming_accuracy(df: DataFrame) -> DataFrame:
    """One minus the share of mismatching cells, counted row by row."""
    wrong = F.aggregate(
        F.zip_with("y_true", "y_pred", lambda t, p: F.abs(t - p)), F.lit(0), lambda acc, x: acc + x
    )
    return df.agg((1.0 - ratio(F.sum(wrong), F.sum(F.size("y_true")))).alias("hamming_acc"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def classification_report(df: DataFrame, classes: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class and for four averages.

    ``classes`` is the one-row table of class names in array order.
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    names = classes.select(F.posexplode("classes").alias("pos", "label"))
    counts = cell_counts(df).join(names, "pos")

    def scores(a: Column, b: Column, c: Column) -> list[Column]:
        return [
            ratio(a, a + b).alias("precision"),
            ratio(a, a + c).alias("recall"),
            f1(a, b, c).alias("f1"),
            (a + c).cast("bigint").alias("support"),
        ]

    per_class = counts.select("label", "tp", "fp", "fn", *scores(tp, fp, fn))
    measures = ["precision", "recall", "f1"]
    support = F.sum("support").cast("bigint").alias("support")
    micro = scores(F.sum(tp), F.sum(fp), F.sum(fn))
    macro = [F.avg(m).alias(m) for m in measures] + [support]
    weighted = [ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures] + [support]
    named = {"micro avg": micro, "macro avg": macro, "weighted avg": weighted}
    # One pass over the class rows gives the three averages side by side.
    averages = per_class.agg(
        F.array(*[F.struct(F.lit(name).alias("label"), *cols) for name, cols in named.items()]).alias("rows")
    ).select(F.inline("rows"))
    hit = _sum(F.zip_with("y_true", "y_pred", lambda t, p: t * p))
    samples = (
        df.select(hit.alias("tp"), _sum(F.col("y_pred")).alias("np"), _sum(F.col("y_true")).alias("nt"))
        .agg(
            F.avg(ratio(tp, F.col("np"))).alias("precision"),
            F.avg(ratio(tp, F.col("nt"))).alias("recall"),
            F.avg(ratio(2 * tp, F.col("np") + F.col("nt"))).alias("f1"),
            F.sum("nt").cast("bigint").alias("support"),
        )
        .select(F.lit("samples avg").alias("label"), *measures, "support")
    )
    return per_class.drop("tp", "fp", "fn").unionByName(averages).unionByName(samples)


def mode_comparison(predictions: DataFrame, mode: str, order: Sequence[str]) -> DataFrame:
    """The four scores per mode, in the given mode order."""
    place = F.array_position(F.lit(list(order)), F.col(mode))
    return multilabel_scores(predictions, [mode]).orderBy(place)


# --- losses and epochs ------------------------------------------------------------


def bce_rows(df: DataFrame, logits: str = "logits", y_true: str = "y_true", name: str = "loss") -> DataFrame:
    """Mean binary cross-entropy over the classes of each row."""
    cells = F.zip_with(logits, y_true, lambda x, t: bce_with_logits(x, t.cast("double")))
    return df.withColumn(name, F.aggregate(cells, F.lit(0.0), lambda acc, v: acc + v) / F.size(logits))


def bce_loss(df: DataFrame, logits: str = "logits", y_true: str = "y_true", batch: str | None = None) -> DataFrame:
    """``row_mean``, and with a batch column also the mean of the batch means."""
    rows = bce_rows(df, logits, y_true)
    if batch is None:
        return rows.agg(F.avg("loss").alias("row_mean"))
    return batch_means(rows, batch)


def batch_means(rows: DataFrame, batch: str, loss: str = "loss") -> DataFrame:
    """``row_mean`` of the losses and the mean of their batch means; only narrow rows are needed."""
    means = rows.groupBy(batch).agg(F.sum(loss).alias("s"), F.count(F.lit(1)).alias("n"))
    return means.agg(
        (F.sum("s") / F.sum("n")).alias("row_mean"), F.avg(F.col("s") / F.col("n")).alias("batch_mean")
    )


def cross_entropy_rows(df: DataFrame, logits: str, y_true: str, name: str = "loss") -> DataFrame:
    """``logsumexp(logits) - logits[true]`` per row; ``y_true`` is a class position."""
    return df.withColumn(name, log_sum_exp(F.col(logits)) - F.get(F.col(logits), F.col(y_true)))


def cross_entropy_loss(df: DataFrame, logits: str, y_true: str) -> DataFrame:
    return cross_entropy_rows(df, logits, y_true).agg(F.avg("loss").alias("loss"))


def best_epoch(df: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """First epoch with the highest score of each run, with all of that epoch's columns.

    A run whose scores never exceed 0 has no best epoch.
    """
    positive = df.where(F.col(score) > 0)
    return top_per_group(positive, run, [F.desc(score), F.asc(epoch)], 1).drop("rank")


def epoch_time_mean(df: DataFrame, run: str, seconds: str) -> DataFrame:
    return df.groupBy(run).agg(F.avg(seconds).alias("mean_seconds"))


def epoch_loss_mean(df: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    return df.groupBy(run, epoch).agg((F.sum(loss) / F.count(loss)).alias("mean_loss"))

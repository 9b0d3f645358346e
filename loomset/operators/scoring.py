"""Rows scored against class vectors: zero-shot, linear heads, batch hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomset.functions.vectors import dot, fuse_mean, softmax, threshold_all, unit
from loomset.plans.pairs import grid_pairs

MAX_MATRIX_CLASSES = 4096
MODES = ["image_only", "text_only", "multimodal"]


def matrix_scores(weights: np.ndarray, bias: np.ndarray, cosine: bool, scale: float):
    """Arrow function: one matrix product per batch of rows."""

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        rows, (classes, dim) = len(vectors), weights.shape
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
        if cosine:
            lengths = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)
        values = (x @ weights.T) * scale + bias
        valid = np.asarray(vectors.is_valid())
        ends = np.concatenate([[0], np.cumsum(np.where(valid, classes, 0))]).astype(np.int32)
        missing = None if valid.all() else pa.array(~valid)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=missing)

    return score


def class_scores(
    items: DataFrame,
    id_col: str,
    vector: str,
    classes: DataFrame,
    class_col: str,
    class_vector: str,
    scale: float = 1.0,
    bias: str | None = None,
    cosine: bool = True,
    output: str = "scores",
    max_classes: int = MAX_MATRIX_CLASSES,
) -> DataFrame:
    """Add ``scores ARRAY<DOUBLE>``, one per class in class order.

    ``scale * cosine(item, class)``, or ``scale * w.x + b`` with ``cosine=False``. Up to
    ``max_classes`` class vectors become one matrix and every row is scored where it
    is: no join and no shuffle. The table is read only one row past that limit to
    tell. More classes than that are paired with the items on a grid, and the
    scores of an item are put together again by its id and vector. A vector that is null,
    holds a null or has another length than the classes has null scores, and rows
    that repeat an id keep their own scores.
    """
    fields = [F.col(class_col).alias("c"), F.col(class_vector).cast("array<double>").alias("v")]
    fields.append(F.col(bias).cast("double").alias("b") if bias else F.lit(0.0).alias("b"))
    heads = classes.select(*fields)
    head = sorted(heads.limit(max_classes + 1).collect(), key=lambda r: r["c"])
    if not head:
        raise ValueError("no class vectors")
    dim = len(head[0]["v"])
    if any(len(r["v"]) != dim for r in head):
        raise ValueError("class vectors of different lengths")
    given = F.col(vector).cast("array<double>")
    whole = F.when((F.size(given) == dim) & F.forall(given, lambda v: v.isNotNull()), given)
    if len(head) <= max_classes:
        weights = np.array([r["v"] for r in head], dtype=np.float64)
        if cosine:
            lengths = np.linalg.norm(weights, axis=1, keepdims=True)
            weights = np.divide(weights, lengths, out=np.zeros_like(weights), where=lengths > 0)
        udf = matrix_scores(weights, np.array([r["b"] for r in head]), cosine, scale)
        return items.withColumn(output, udf(whole))
    x, w = F.col("_v"), F.col("v")
    keyed = items.withColumn("_v", whole)
    keyed = keyed.withColumn("_key", F.struct(F.col(id_col), F.xxhash64("_v"), F.xxhash64("_v", F.lit(1)))).drop("_v")
    left = items.select(id_col, whole.alias("_v")).filter("_v is not null")
    left = left.withColumn("_key", F.struct(F.col(id_col), F.xxhash64("_v"), F.xxhash64("_v", F.lit(1))))
    left = left.dropDuplicates(["_key"]).select("_key", (unit(x) if cosine else x).alias("_x"))
    right = heads.select("c", (unit(w) if cosine else w).alias("_w"), "b")
    pairs = grid_pairs(left, right, "_key", "c", left_parts=2048, right_parts=4).select(
        "_key", F.struct("c", (dot(F.col("_x"), F.col("_w")) * scale + F.col("b")).alias("s")).alias("cell")
    )
    # One row's own scores: as many as there are classes, like the answer itself.
    scored = pairs.groupBy("_key").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    wide = scored.select("_key", F.transform("cells", lambda c: c["s"]).alias(output))
    return keyed.join(wide, "_key", "left").drop("_key")


def class_names(classes: DataFrame, class_col: str) -> DataFrame:
    """One row with the class names in the order of the score arrays."""
    return classes.agg(F.sort_array(F.collect_set(class_col)).alias("names"))


def long_scores(df: DataFrame, id_cols: list[str], names: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """``(ids, class, *values)``: score arrays (``{array: value name}``) beside their class names.

    The names are a constant of the plan, laid beside the arrays in each row: no join.
    """
    named = df.withColumn("_names", names.select("names").scalar())
    parts = [F.col("_names").alias("class")] + [F.col(a).alias(v) for a, v in arrays.items()]
    return named.select(*id_cols, F.inline(F.arrays_zip(*parts)))


def zero_shot_predict(
    items: DataFrame,
    id_col: str,
    image_vector: str,
    text_vector: str,
    image_classes: DataFrame,
    text_classes: DataFrame,
    class_col: str,
    class_vector: str,
    scale: float,
    cut: float = 0.1,
    blank_image: Sequence[float] | None = None,
    blank_text: Sequence[float] | None = None,
) -> DataFrame:
    """Probabilities and 0/1 predictions of all three modes in one pass over the rows.

    Adds ``probs_<mode>`` and ``pred_<mode>``. A row without one of its vectors is scored with that of
    a blank image or an empty text, where ``blank_image`` or ``blank_text`` gives it, and else by
    the other vector alone; a mode that it cannot have is null.
    """
    scored = items
    sides = ((image_vector, blank_image, image_classes, "_i"), (text_vector, blank_text, text_classes, "_t"))
    for vector, blank, classes, output in sides:
        given = F.col(vector).cast("array<double>")
        filled = given if blank is None else F.coalesce(given, F.lit([float(x) for x in blank]))
        scored = scored.withColumn("_given", filled)
        scored = class_scores(scored, id_col, "_given", classes, class_col, class_vector, scale, output=output).drop("_given")
    probs = (
        scored.withColumn("probs_image_only", softmax(F.col("_i")))
        .withColumn("probs_text_only", softmax(F.col("_t")))
        .withColumn("probs_multimodal", fuse_mean(F.col("probs_image_only"), F.col("probs_text_only")))
        .drop("_i", "_t")
    )
    return probs.withColumns({f"pred_{m}": threshold_all(F.col(f"probs_{m}"), cut) for m in MODES})


def by_mode(predicted: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row and mode that it has: ``(*columns, mode, probs, y_pred)``."""
    choices = F.array(
        *[
            F.struct(F.lit(m).alias("mode"), F.col(f"probs_{m}").alias("probs"), F.col(f"pred_{m}").alias("y_pred"))
            for m in MODES
        ]
    )
    return predicted.select(*columns, F.inline(F.filter(choices, lambda m: m["probs"].isNotNull())))


def linear_head_scores(
    items: DataFrame,
    id_col: str,
    vector: str,
    weights: DataFrame,
    class_col: str,
    weight_vector: str,
    bias: str,
    output: str = "logits",
) -> DataFrame:
    """``W x + b`` for a weight table with one row per class."""
    return class_scores(
        items, id_col, vector, weights, class_col, weight_vector, bias=bias, cosine=False, output=output
    )


def model_scores(
    items: DataFrame,
    vector: str,
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    size: int,
    output: str = "scores",
    batch_size: int = 1024,
) -> DataFrame:
    """Add the outputs ``ARRAY<DOUBLE>`` of a model that each worker loads once.

    ``load`` gives a function from ``[rows, size]`` to ``[rows, outputs]``; it is called with at most
    ``batch_size`` vectors. Vectors that are null, hold a null or have another size get null.
    """
    given = F.col(vector).cast("array<double>")
    whole = F.when((F.size(given) == size) & F.forall(given, lambda v: v.isNotNull()), given)
    zeros = F.array_repeat(F.lit(0.0), size)
    score = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[size]])
    scored = items.withColumn("_given", whole)
    scored = scored.withColumn(output, F.when(F.col("_given").isNotNull(), score(F.coalesce("_given", zeros))))
    return scored.drop("_given")


def linear_head_model(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader for ``model_scores`` of ``W x + b``."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        matrix = np.ascontiguousarray(weights.T)
        return lambda rows: rows @ matrix + bias

    return load


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a function to Arrow-sized batches of rows, inside their partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return chain.from_iterable([fn(batch)] for batch in batches)

    return df.mapInPandas(run, schema)

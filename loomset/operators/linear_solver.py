"""Linear models with many outputs, fitted by full passes over a distributed table.

A pass computes, for each Arrow batch, one gradient matrix over all classes; tasks add
theirs up, the sums meet in a tree, and only a matrix of the size of the
model reaches the driver. Several models with features of their own share each pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.vectors import argmax, sigmoid, threshold
from loomset.operators.scoring import matrix_scores
from loomset.plans.tree import sum_vectors
from loomset.sources.storage import stored

#: Bounds of the curvature of the two losses, by the mean squared length of a row.
CURVATURE = {"softmax": 0.5, "sigmoid": 0.25}


def whole_vector(vector: Column, size: int | None = None) -> Column:
    """The vector in doubles; null if it is null, holds a null or NaN, or has another size."""
    given = vector.cast("array<double>")
    sound = F.forall(given, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(sound if size is None else sound & (F.size(given) == size), given)


@dataclass
class LinearModel:
    """``weights [classes, size]`` and ``bias [classes]`` of one loss."""

    kind: str
    weights: np.ndarray
    bias: np.ndarray

    def logits(self, features: Column) -> Column:
        score = matrix_scores(self.weights, self.bias, cosine=False, scale=1.0)
        return score(whole_vector(features, self.weights.shape[1]))

    def predicted(self, logits: Column, cut: float) -> Column:
        """The class with the largest logit, or 0/1 for every class whose probability is above the cut."""
        if self.kind == "softmax":
            return argmax(logits)
        return F.transform(logits, lambda z: threshold(sigmoid(z), cut))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _truth(column: pa.Array, kind: str, classes: int) -> np.ndarray:
    """``[rows, classes]`` zeros and ones."""
    if kind == "sigmoid":
        return _matrix(column).astype(np.float64)
    return (column.to_numpy(zero_copy_only=False)[:, None] == np.arange(classes)).astype(np.float64)


def _probabilities(logits: np.ndarray, kind: str) -> np.ndarray:
    if kind == "sigmoid":
        small = np.exp(-np.abs(logits))
        return np.where(logits >= 0, 1.0, small) / (1.0 + small)
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def _summed(rows: DataFrame, add, size: int) -> np.ndarray:
    """The sum over all tasks of the vectors that ``add`` makes of their batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["total"])

    return np.array(sum_vectors(rows.mapInArrow(run, "total ARRAY<DOUBLE>"), "total").first()[0])


def fit_linear(
    train: DataFrame,
    features: Mapping[str, Column],
    target: Column,
    kind: str,
    classes: int | None = None,
    passes: int = 5,
    reg: float = 1e-3,
) -> dict[str, LinearModel]:
    """One model for each set of features, by ``passes`` accelerated gradient steps over all rows.

    ``kind`` ``softmax`` has a target class from 0, ``sigmoid`` an array of 0/1, one for each class. Biases start at
    the classes' log odds, weights at 0; the step is the inverse of a bound of the curvature,
    the momentum after k steps ``k / (k + 3)``, and ``reg`` draws the weights to 0. Nothing is
    drawn at random, so plain arithmetic repeats it. Rows without a sound
    vector of the common size, or without a target, take no part.
    """
    names = list(features)
    columns = [whole_vector(v).alias(f"x{i}") for i, v in enumerate(features.values())]
    goal = target.cast("int") if kind == "softmax" else whole_vector(target)
    rows = stored(train.select(goal.alias("y"), *columns), "probe-rows").filter("y IS NOT NULL")
    for i in range(len(names)):
        rows = rows.filter(F.col(f"x{i}").isNotNull())
    top = F.max("y") + 1 if kind == "softmax" else F.max(F.size("y"))
    first = rows.agg(top, *[F.max(F.size(f"x{i}")) for i in range(len(names))]).first()
    if first[0] is None:
        raise ValueError("no training rows")
    classes, sizes = classes or first[0], list(first[1:])
    for i, size in enumerate(sizes):
        rows = rows.filter(F.size(f"x{i}") == size)
    rows = rows.filter((F.col("y") >= 0) & (F.col("y") < classes) if kind == "softmax" else F.size("y") == classes)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        squares = [(_matrix(batch.column(f"x{i}")) ** 2).sum() for i in range(len(sizes))]
        return np.concatenate(([batch.num_rows], squares, _truth(batch.column("y"), kind, classes).sum(axis=0)))

    found = _summed(rows, moments, 1 + len(sizes) + classes)
    n, squares, counts = found[0], found[1 : 1 + len(sizes)], found[1 + len(sizes) :]
    if not n:
        raise ValueError("no training rows")
    bias = np.log(counts + 0.5) - (np.log(n - counts + 0.5) if kind == "sigmoid" else 0.0)
    steps = 1.0 / (CURVATURE[kind] * (squares / n + 1.0) + reg)
    now = [np.column_stack((np.zeros((classes, size)), bias)) for size in sizes]
    before = now
    for k in range(passes):
        at = [w + k / (k + 3) * (w - v) for w, v in zip(now, before)]

        def gradients(batch: pa.RecordBatch) -> np.ndarray:
            truth, parts = _truth(batch.column("y"), kind, classes), []
            for i, w in enumerate(at):  # noqa: B023
                x = _matrix(batch.column(f"x{i}"))
                wrong = _probabilities(x @ w[:, :-1].T + w[:, -1], kind) - truth
                parts.append(np.column_stack((wrong.T @ x, wrong.sum(axis=0))).ravel())
            return np.concatenate(parts)

        total = _summed(rows, gradients, sum(w.size for w in at))
        ends = np.cumsum([w.size for w in at])[:-1]
        slopes = [g.reshape(w.shape) / n + reg * w * (np.arange(w.shape[1]) < w.shape[1] - 1) for g, w in zip(np.split(total, ends), at)]
        before, now = now, [w - step * g for w, step, g in zip(at, steps, slopes)]
    return {name: LinearModel(kind, w[:, :-1], w[:, -1]) for name, w in zip(names, now)}

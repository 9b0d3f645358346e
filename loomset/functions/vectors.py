"""Vector expressions on ``ARRAY`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.binding import let


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(vector: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    return let(
        F.struct(as_doubles(vector).alias("v"), norm(vector).alias("n")),
        lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(F.lit(0.0))),
    )


def softmax(scores: Column) -> Column:
    """Softmax over the array, shifted by its maximum."""
    shifted = let(
        F.struct(as_doubles(scores).alias("v"), F.array_max(as_doubles(scores)).alias("m")),
        lambda s: F.transform(s["v"], lambda x: F.exp(x - s["m"])),
    )
    return let(
        let(shifted, lambda e: F.struct(e.alias("e"), total(e).alias("t"))),
        lambda s: F.transform(s["e"], lambda x: x / s["t"]),
    )


def log_sum_exp(scores: Column) -> Column:
    return let(
        F.struct(as_doubles(scores).alias("v"), F.array_max(as_doubles(scores)).alias("m")),
        lambda s: s["m"] + F.log(F.aggregate(s["v"], F.lit(0.0), lambda acc, x: acc + F.exp(x - s["m"]))),
    )


def sigmoid(x: Column) -> Column:
    """Logistic function in the form that cannot overflow."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (1.0 + small)).otherwise(small / (1.0 + small))


def fuse_concat(a: Column, b: Column) -> Column:
    """Features of two modalities side by side."""
    return F.concat(a, b)


def fuse_mean(a: Column, b: Column) -> Column:
    """Element-wise mean of two probability vectors."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2.0)


def threshold(probability: Column, cut: float) -> Column:
    """1 where the probability is strictly above the cut, else 0."""
    return (probability > F.lit(cut)).cast("int")


def threshold_all(probabilities: Column, cut: float) -> Column:
    return F.transform(probabilities, lambda p: threshold(p, cut))


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest entry; the first one wins ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def bce_with_logits(logit: Column, truth: Column) -> Column:
    """Binary cross-entropy of one cell in its stable form."""
    return F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit)))

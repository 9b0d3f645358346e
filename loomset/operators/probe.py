"""Linear classifiers on frozen features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.linear_solver import fit_linear


def _features(df: DataFrame, features: Column) -> DataFrame:
    return df.withColumn("_features", array_to_vector(features.cast("array<double>")))


def probe_hidden(
    train: DataFrame, test: DataFrame, features: Column, label: str, hidden: int, passes: int = 5, output: str = "y_pred"
) -> DataFrame:
    """One label per row from a network with one hidden layer (sigmoid units, no dropout)."""
    fit_rows = _features(train, features).select("_features", F.col(label).cast("double").alias("_label")).persist()
    columns = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction"}
    try:
        width, top = fit_rows.agg(F.max(F.size(vector_to_array("_features"))), F.max("_label").cast("int")).first()
        layers = [width, hidden, top + 1]
        model = MultilayerPerceptronClassifier(maxIter=passes, layers=layers, seed=42, **columns).fit(fit_rows)
    finally:
        fit_rows.unpersist()
    scored = model.transform(_features(test, features))
    return scored.select(*test.columns, F.col("_prediction").cast("int").alias(output))


def probe_modes(
    train: DataFrame,
    test: DataFrame,
    modes: Mapping[str, Column],
    target: str,
    keep: Sequence[str],
    kind: str = "softmax",
    classes: int | None = None,
    cut: float = 0.3,
    passes: int = 5,
    reg: float = 1e-3,
) -> DataFrame:
    """``(mode, *keep, target, y_pred)``: predictions of one linear model for each set of features.

    All models are fitted in the same passes and all applied in one pass over the test rows. A row
    without a mode's features has a null prediction there.
    """
    models = fit_linear(train, modes, F.col(target), kind, classes, passes, reg)
    logits = test.withColumns({f"_z{i}": models[m].logits(modes[m]) for i, m in enumerate(modes)})
    choices = [
        F.struct(F.lit(m).alias("mode"), models[m].predicted(F.col(f"_z{i}"), cut).alias("y_pred")) for i, m in enumerate(modes)
    ]
    kept = list(dict.fromkeys([*keep, target]))
    long = logits.select(*kept, F.explode(F.array(*choices)).alias("_m"))
    return long.select("_m.mode", *kept, "_m.y_pred")


def probe_single(
    train: DataFrame,
    test: DataFrame,
    features: Column,
    label: str,
    passes: int = 5,
    reg: float = 1e-3,
    hidden: int | None = None,
    output: str = "y_pred",
) -> DataFrame:
    """Predict one label per row after ``passes`` passes; ``hidden`` puts one hidden layer in between."""
    if hidden is not None:
        return probe_hidden(train, test, features, label, hidden, passes, output)
    model = fit_linear(train, {"all": features}, F.col(label), "softmax", None, passes, reg)["all"]
    scored = test.withColumn("_z", model.logits(features))
    return scored.select(*test.columns, model.predicted(F.col("_z"), 0.5).alias(output))


def probe_multilabel(
    train: DataFrame,
    test: DataFrame,
    features: Column,
    y_true: str,
    n_classes: int,
    cut: float = 0.3,
    passes: int = 5,
    reg: float = 1e-3,
) -> DataFrame:
    """One model with an output for each class; adds ``y_pred ARRAY<INT>`` at ``probability > cut``."""
    model = fit_linear(train, {"all": features}, F.col(y_true), "sigmoid", n_classes, passes, reg)["all"]
    scored = test.withColumn("_z", model.logits(features))
    return scored.select(*test.columns, model.predicted(F.col("_z"), cut).alias("y_pred"))


def modalities(image: str, text: str) -> dict[str, Column]:
    """Feature column per mode; both together are laid side by side."""
    return {
        "image_only": F.col(image),
        "text_only": F.col(text),
        "multimodal": F.concat(F.col(image), F.col(text)),
    }


def linear_probe(
    train: DataFrame, test: DataFrame, image: str, text: str, label: str, keep: Sequence[str], passes: int = 5
) -> DataFrame:
    """Predictions of the three modes: ``(mode, *keep, label, y_pred)``."""
    return probe_modes(train, test, modalities(image, text), label, keep, passes=passes)

"""Class means, similarity and pixel statistics of fixed-length vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.vectors import dot, unit
from loomset.plans.pairs import grid_pairs


def class_mean_vector(df: DataFrame, label: str, vector: str, output: str = "vector") -> DataFrame:
    """Element-wise mean per class.

    Every task keeps one running mean per class, whatever the vector width, and the
    vectors themselves are never shuffled.
    """
    dense = df.select(label, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return dense.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(output))


def vector_entries(df: DataFrame, key: str, vector: str, name: str = "value") -> DataFrame:
    """Long format ``(key, pos, value)``."""
    return df.select(key, F.posexplode(vector).alias("pos", name))


def class_similarity(means: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """Cosine of every pair of class vectors; 0 beside a zero vector.

    Vectors are scaled to length 1 once, before they are paired.
    """
    scaled = means.select(F.col(label).alias("a"), unit(F.col(vector)).alias("u"))
    other = scaled.select(F.col("a").alias("b"), F.col("u").alias("w"))
    return grid_pairs(scaled, other, "a", "b").select("a", "b", dot(F.col("u"), F.col("w")).alias("similarity"))


def _channel_values(df: DataFrame, pixels: str, channels: int) -> DataFrame:
    return df.select(F.posexplode(pixels).alias("pos", "value")).select(
        (F.col("pos") % channels).alias("channel"), "value"
    )


def pixel_histogram(df: DataFrame, pixels: str, channels: int = 3, levels: int = 256) -> DataFrame:
    """Pixels per channel and integer value; values that never occur are there with 0."""
    counts = _channel_values(df, pixels, channels).groupBy("channel", "value").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(channels * levels).select(
        F.floor(F.col("id") / levels).cast("int").alias("channel"), (F.col("id") % levels).cast("int").alias("value")
    )
    return grid.join(counts, ["channel", "value"], "left").select(
        "channel", "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def channel_means(df: DataFrame, pixels: str, channels: int = 3) -> DataFrame:
    return _channel_values(df, pixels, channels).groupBy("channel").agg(F.avg("value").alias("mean"))

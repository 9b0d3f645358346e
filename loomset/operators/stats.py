"""Counts, histograms, quantile filters and density curves of one column."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.plans.quantiles import exact_quantile
from loomset.plans.tree import sum_vectors
from loomset.sources.storage import stored


#: Bits of each of the two whole numbers that hold a sum of kernel values.
LIMB_BITS = 21


def decode(label: Column, names: Mapping[int, str]) -> Column:
    """Label id to name through a small fixed dictionary; unknown gives null.

    The dictionary is a constant of the plan: no join, no shuffle.
    """
    entries = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), label)


def class_distribution(df: DataFrame, category: str, name: str = "n") -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias(name)).orderBy(category)


def class_distribution_by_split(
    df: DataFrame, split: str, label: str, names: Mapping[int, str], name: str = "n"
) -> DataFrame:
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias(name))
    return counts.withColumn("class_name", decode(F.col(label), names)).orderBy(split, label)


def value_counts(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin number, settled by comparing with the bin's own edges."""
    step = (high - low) / bins
    guess = F.least(F.floor((x - low) * (F.lit(float(bins)) / (high - low))), F.lit(bins - 1))
    down = (x < low + guess * step).cast("int")
    up = ((x >= low + (guess + 1) * step) & (guess < bins - 1)).cast("int")
    return guess - down + up


def _histogram(df: DataFrame, column: str, edges: DataFrame, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between the one-row ``edges(lo, hi)``.

    Values outside get bin -1 and fall out after the counting. A filter on the value, or
    a bin that may be null, would be pushed below and compute a derived column again.
    """
    ends = edges.select(F.struct("lo", "hi").alias("e")).scalar()
    placed = df.select(F.col(column).cast("double").alias("x"), ends.alias("e"))
    number = _bin(F.col("x"), F.col("e.lo"), F.col("e.hi"), bins).cast("int")
    counts = (
        placed.select(
            F.coalesce(F.when(F.col("x").between(F.col("e.lo"), F.col("e.hi")), number), F.lit(-1)).alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ends.alias("e"))
    step = (F.col("e.hi") - F.col("e.lo")) / bins
    return (
        grid.join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("e.lo") + F.col("bin") * step).alias("bin_start"),
            (F.col("e.lo") + (F.col("bin") + 1) * step).alias("bin_end"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        )
        .orderBy("bin")
    )


def _widen(low: Column, high: Column) -> tuple[Column, Column]:
    """An empty range becomes one of width 1 around its value."""
    half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    return low - half, high + half


def stored_values(df: DataFrame, column: str) -> DataFrame:
    """``(x)``: the values of one column, computed once and written; NaN is missing like null."""
    values = stored(df.select(F.col(column).cast("double").alias("x")), "values")
    return values.select(F.nullif("x", F.lit(math.nan)).alias("x"))


def quantile_histogram(df: DataFrame, column: str, q: float = 0.99, bins: int = 50) -> DataFrame:
    """Bins over ``[0, quantile q]``; larger values are left out, empty bins stay.

    The column is computed once and stored, as the quantile and the counts both read it.
    """
    values = stored_values(df, column)
    top = exact_quantile(values, "x", q, "hi")
    low, high = _widen(F.lit(0.0), F.col("hi"))
    return _histogram(values, "x", top.select(low.alias("lo"), high.alias("hi")), bins)


def auto_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Bins over ``[min, max]``, the last one closed on both sides. The column is computed once and stored."""
    values = stored_values(df, column)
    ends = values.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    low, high = _widen(F.col("a"), F.col("b"))
    return _histogram(values, "x", ends.select(low.alias("lo"), high.alias("hi")), bins)


def quantile_outlier_filter(df: DataFrame, column: str, q: float = 0.95) -> DataFrame:
    """Rows strictly below the quantile of ``column``."""
    return df.where(F.col(column) < exact_quantile(df, column, q).scalar())


def max_scaled(df: DataFrame, column: str, scale: float = 255.0, name: str = "scaled") -> DataFrame:
    """``x / max(x) * scale`` over the whole table."""
    top = df.agg(F.max(F.col(column).cast("double"))).scalar()
    return df.withColumn(name, F.try_divide(F.col(column).cast("double"), top) * F.lit(scale))


def _kernel_sums(grid: np.ndarray, width: float):
    """Arrow function: what the values of a task add to each point of the grid, as one vector of two limbs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(grid)), np.int64)
        for batch in batches:
            values, times = np.unique(batch.column("x").to_numpy(), return_counts=True)
            for at in range(0, len(values), 4096):
                z = (grid[:, None] - values[None, at : at + 4096]) / width
                kernel = np.rint(np.exp(z * z * -0.5) * 4.0**LIMB_BITS).astype(np.int64)
                sums[0] += (kernel >> LIMB_BITS) @ times[at : at + 4096]
                sums[1] += (kernel & ((1 << LIMB_BITS) - 1)) @ times[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.int64()))], ["sums"])

    return add


def kde_curve(df: DataFrame, column: str, points: int = 200, bins: int = 50) -> DataFrame:
    """Gaussian density on a grid over ``[min, max]`` with Scott's bandwidth.

    ``density`` integrates to one; ``scaled`` is the overlay of a count histogram
    with ``bins`` bins. The column is computed once and stored. Each task then keeps one sum for every
    point of the grid, whatever the number of its values, and those are added up. The kernel is
    rounded to 42 binary places, so sums are whole numbers and do not depend on how the values are
    dealt out. Null and NaN are missing. A column without spread has no density: it is null; one
    without values has no curve.
    """
    values = stored_values(df, column).filter("x is not null")
    n, sd, low, high = values.agg(F.count("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()
    grid = df.sparkSession.range(points if n else 0).select(F.col("id").cast("int").alias("point"))
    if not sd:
        empty = F.lit(None).cast("double")
        return grid.select("point", F.lit(low).cast("double").alias("x"), empty.alias("density"), empty.alias("scaled"))
    width = float(f"{sd * n**-0.2:.12g}")  # the last digits hang on the order of the sum
    places = low + np.arange(points) * (high - low) / (points - 1)
    sums = sum_vectors(values.mapInArrow(_kernel_sums(places, width), "sums ARRAY<BIGINT>"), "sums")
    limbs = F.arrays_zip(F.slice("sums", 1, points).alias("a"), F.slice("sums", points + 1, points).alias("b"))
    mass = F.transform(limbs, lambda x: x["a"] / 2.0**LIMB_BITS + x["b"] / 4.0**LIMB_BITS)
    at = F.lit(low) + F.col("point") * F.lit(high - low) / (points - 1)
    density = F.col("mass") / (n * width * math.sqrt(2.0 * math.pi))
    curve = sums.select(F.posexplode(mass).alias("point", "mass"))
    scaled = density * (n * (high - low) / bins)
    return curve.select("point", at.alias("x"), density.alias("density"), scaled.alias("scaled")).orderBy("point")

"""Statistics of the pixels of scanned images, kept in counters of fixed size.

Every task adds the bytes of its images to one table of counters, or one sum a class, and
returns that; there is no row for a pixel. The counters are whole numbers, so
results do not depend on how the images are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.plans.tree import sum_vectors

CHANNELS, LEVELS = 3, 256
#: Bytes of class sums that a task holds before it returns them.
MAX_SUM_BYTES = 64 << 20


def _planes(data: pa.Scalar, height: int, width: int, channels: int) -> np.ndarray:
    """``[3, pixels]`` red, green and blue bytes; gray is all three, alpha is dropped."""
    image = np.frombuffer(data.as_buffer(), np.uint8).reshape(height * width, channels)
    return np.broadcast_to(image[:, 0], (CHANNELS, len(image))) if channels == 1 else image[:, 2::-1].T


def _images(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(row, height, width, planes)`` of the readable images of a batch."""
    data, *sides = (batch.column(c) for c in ("data", "height", "width", "channels"))
    for row, (height, width, channels) in enumerate(zip(*(s.to_pylist() for s in sides))):
        if data[row].is_valid and None not in (height, width, channels):
            yield row, height, width, _planes(data[row], height, width, channels)


def pixel_counts(images: DataFrame) -> DataFrame:
    """``(channel, value, n)``: pixels of red (0), green and blue with each of the 256 values, also those without any.

    ``images`` are rows of ``scan_images``; unreadable ones count nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((CHANNELS, LEVELS), np.int64)
        for batch in batches:
            for _, _, _, planes in _images(batch):
                for channel in range(CHANNELS):
                    counts[channel] += np.bincount(planes[channel], minlength=LEVELS)
        one = pa.array([counts.ravel()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([one], ["n"])

    parts = images.select("data", "height", "width", "channels").mapInArrow(count, "n ARRAY<BIGINT>")
    zeros = images.sparkSession.range(1).select(F.array_repeat(F.lit(0).cast("bigint"), CHANNELS * LEVELS).alias("n"))
    total = sum_vectors(parts.unionByName(zeros), "n")
    return total.select(F.posexplode("n").alias("at", "n")).select(
        F.floor(F.col("at") / LEVELS).cast("int").alias("channel"), (F.col("at") % LEVELS).alias("value"), "n"
    )


def counted_channel_means(counts: DataFrame) -> DataFrame:
    """``(channel, mean)`` over all pixels, from ``pixel_counts``; null without pixels."""
    mean = F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n"))
    return counts.groupBy("channel").agg(mean.alias("mean"))


def class_mean_image(images: DataFrame, label: Column, max_sum_bytes: int = MAX_SUM_BYTES) -> DataFrame:
    """``(label, height, width, n, vector)``: the mean image of each class and size, red, green, blue, pixel by pixel.

    Images of one class but of different sizes have means of their own. A task that sees many
    classes or large images returns its sums whenever they take ``max_sum_bytes``.
    """
    kind = images.select(label.alias("label")).schema["label"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        held, schema = 0, None
        for batch in batches:
            labels, schema = batch.column("label"), batch.schema.field("label")
            for row, height, width, planes in _images(batch):
                key = labels[row].as_py(), height, width
                if key not in sums:
                    sums[key] = np.zeros(1 + planes.size, np.int64)
                    held += sums[key].nbytes
                sums[key][0] += 1
                sums[key][1:] += planes.T.ravel()
                if held > max_sum_bytes:
                    yield given(sums, schema)
                    sums, held = {}, 0
        if sums:
            yield given(sums, schema)

    def given(sums: dict[tuple, np.ndarray], field: pa.Field) -> pa.RecordBatch:
        labels, heights, widths = zip(*sums)
        vectors = pa.array(list(sums.values()), pa.list_(pa.int64()))
        arrays = [pa.array(labels, field.type), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), vectors]
        return pa.RecordBatch.from_arrays(arrays, ["label", "height", "width", "vector"])

    rows = images.select(label.alias("label"), "data", "height", "width", "channels")
    parts = rows.mapInArrow(add, f"label {kind}, height INT, width INT, vector ARRAY<BIGINT>")
    total = sum_vectors(parts, "vector", ["label", "height", "width"])
    n = F.col("vector")[0]
    mean = F.transform(F.slice("vector", 2, F.size("vector") - 1), lambda x: x / n)
    return total.select("label", "height", "width", n.alias("n"), mean.alias("vector"))

"""Image quality measures, one image at a time inside the scan's own tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators.stats import value_counts
from loomset.plans.quantiles import exact_quantile

QUALITY_FIELDS = "sharpness DOUBLE, contrast DOUBLE, r_avg DOUBLE, g_avg DOUBLE"
# Luma weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])


def _area_weights(length: int, target: int) -> np.ndarray:
    """``[target, length]``: the share of each old pixel in each new one, rows summing to 1."""
    edges = np.arange(target + 1) * (length / target)
    old = np.arange(length)
    overlap = np.minimum(edges[1:, None], old + 1) - np.maximum(edges[:-1, None], old)
    return np.clip(overlap, 0, None) * (target / length)


def _shrink(image: np.ndarray, limit: int | None) -> np.ndarray:
    """Area means with the longer side at ``limit``; an image that fits is left alone."""
    height, width = image.shape[:2]
    longest = max(height, width)
    if limit is None or longest <= limit:
        return image
    sides = [max(1, round(n * limit / longest)) for n in (height, width)]
    rows, columns = _area_weights(height, sides[0]), _area_weights(width, sides[1])
    return np.rint(np.einsum("ih,hwc,jw->ijc", rows, image, columns, optimize=True))


def quality(rgb: np.ndarray) -> tuple[float, float, float, float]:
    """Variance of the Laplacian, contrast, mean red, mean green of ``[H, W, 3]``."""
    gray = np.floor(rgb @ LUMA + 0.5)
    edge = gray
    for axis, length in enumerate(gray.shape):
        # The border mirrors around the edge pixel; a single row or column repeats.
        widths = [(1, 1) if a == axis else (0, 0) for a in (0, 1)]
        edge = np.pad(edge, widths, mode="reflect" if length > 1 else "edge")
    around = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:]
    return float((around - 4.0 * gray).var()), float(gray.std()), float(rgb[..., 0].mean()), float(rgb[..., 1].mean())


def _rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels in Spark's order (blue first) as red, green, blue; alpha is dropped."""
    image = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(image, 3, axis=2) if channels == 1 else image[:, :, 2::-1]


def image_quality(images: DataFrame, limit: int | None = None) -> DataFrame:
    """Replace ``data`` of scanned images by the four pixel measures.

    Unreadable images keep null measures. Images are measured at full resolution; with a
    ``limit``, those with a longer side are first shrunk to it by area means.
    """

    @F.pandas_udf(QUALITY_FIELDS)
    def measure(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        names = ["sharpness", "contrast", "r_avg", "g_avg"]
        for data, height, width, channels in parts:
            rows = [
                (None,) * 4 if d is None else quality(_shrink(_rgb(d, int(h), int(w), int(c)), limit))
                for d, h, w, c in zip(data, height, width, channels)
            ]
            yield pd.DataFrame(rows, columns=names, dtype="float64")

    # One column of measures, so the pixels cross to Python once per image.
    measured = images.withColumn("_q", measure("data", "height", "width", "channels"))
    return measured.select(
        "path",
        "file_name",
        "width",
        "height",
        (F.col("width") / F.col("height")).alias("aspect_ratio"),
        "color_mode",
        "file_size_kb",
        "_q.sharpness",
        "_q.contrast",
        "_q.r_avg",
        "_q.g_avg",
    )


def metadata_align(rows: DataFrame, quality_rows: DataFrame, key: str, by_path: bool = False) -> DataFrame:
    """Attach the quality columns by key and drop rows without a readable image.

    The key is the file name, or the whole path with ``by_path``. Of readable images with one name in several
    folders the one with the smallest path counts, so every row stays at most one row.
    """
    readable = quality_rows.where(F.col("width").isNotNull())
    own = F.col("path") if by_path else F.col("file_name")
    others = [c for c in readable.columns if c not in ("path", "file_name")]
    first = readable.groupBy(own.alias(key)).agg(F.min_by(F.struct(*others), "path").alias("_first"))
    return rows.join(first.select(key, "_first.*"), key)


def image_size_pairs(images: DataFrame) -> DataFrame:
    return value_counts(images, ["width", "height"])


def sharpness_contrast_filtered(measures: DataFrame, q: float = 0.95) -> DataFrame:
    """``(sharpness, contrast)`` rows strictly below the sharpness quantile."""
    cut = exact_quantile(measures, "sharpness", q).scalar()
    return measures.where(F.col("sharpness") < cut)


def rgb_proxy(measures: DataFrame) -> DataFrame:
    """Mean red, mean green and the width scaled to 255 as a third axis."""
    widest = measures.agg(F.max("width").cast("double")).scalar()
    return measures.withColumn("blue_proxy", F.try_divide(F.col("width").cast("double"), widest) * F.lit(255.0))

"""Counters over image bytes against NumPy, and plans without a row for a pixel."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import pixels as px
from loomset.operators import stats as st
from loomset.plans.tree import sum_vectors

IMAGE = "label STRING, data BINARY, height INT, width INT, channels INT"


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        channels, height, width = [1, 3, 4][i % 3], int(rng.integers(1, 6)), int(rng.integers(1, 6))
        data = rng.integers(0, 256, height * width * channels, dtype=np.uint8)
        rows.append((["a", "b", None][i % 3 if i % 5 else 0], bytearray(data.tobytes()), height, width, channels))
    return rows


def rgb(row):
    """``[pixels, 3]``, red first."""
    image = np.frombuffer(bytes(row[1]), np.uint8).reshape(-1, row[4])
    return np.repeat(image, 3, axis=1) if row[4] == 1 else image[:, [2, 1, 0]]


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([*made(90), ("a", None, None, None, None)], IMAGE).repartition(7)


def test_pixel_counts(spark, images):
    want = np.stack([np.bincount(np.concatenate([rgb(r)[:, c] for r in made(90)]), minlength=256) for c in range(3)])
    counts = px.pixel_counts(images)
    got = np.zeros((3, 256), int)
    for r in counts.collect():
        got[r["channel"], r["value"]] = r["n"]
    assert counts.count() == 768 and (got == want).all()
    means = {r["channel"]: r["mean"] for r in px.counted_channel_means(counts).collect()}
    assert np.allclose([means[c] for c in range(3)], want @ np.arange(256) / want.sum(1))
    empty = px.pixel_counts(images.where("data IS NULL"))
    assert {r["n"] for r in empty.collect()} == {0}
    assert {r["mean"] for r in px.counted_channel_means(empty).collect()} == {None}


@pytest.mark.parametrize("held", [px.MAX_SUM_BYTES, 1])
def test_class_mean_image(images, held):
    groups = {}
    for r in made(90):
        groups.setdefault((r[0], r[2], r[3]), []).append(rgb(r).ravel())
    found = px.class_mean_image(images, F.col("label"), held).collect()
    assert {(r["label"], r["height"], r["width"]) for r in found} == set(groups) and len(found) == len(groups)
    for r in found:
        own = groups[r["label"], r["height"], r["width"]]
        assert r["n"] == len(own) and np.allclose(r["vector"], np.mean(own, axis=0))
    assert not px.class_mean_image(images.where("data IS NULL"), F.col("label")).collect()


def test_no_row_for_a_pixel(spark, images):
    """What tasks return is one row each, and what is shuffled is counters."""
    plan = px.pixel_counts(images)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate posexplode" in plan
    assert plan.index("Generate posexplode") < plan.index("Exchange") < plan.index("MapInArrow")


def test_sums_of_vectors(spark):
    parts = spark.range(500).select((F.col("id") % 3).alias("k"), F.array(F.lit(1 << 53), F.col("id")).alias("v")).repartition(9)
    got = {r["k"]: r["v"] for r in sum_vectors(parts, "v", ["k"], branches=4).collect()}
    assert got == {k: [(1 << 53) * len(range(k, 500, 3)), sum(range(k, 500, 3))] for k in range(3)}
    assert not sum_vectors(parts.where("k > 5"), "v").collect()


def test_kde_of_many_different_values(spark):
    x = np.random.default_rng(1).normal(size=200_000)
    column = spark.createDataFrame([(float(v),) for v in x[:5000]], "x DOUBLE")
    curve = st.kde_curve(column, "x").toPandas()
    some = x[:5000]
    width = some.std(ddof=1) * len(some) ** -0.2
    grid = np.linspace(some.min(), some.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - some) / width) ** 2).sum(1) / (len(some) * width * np.sqrt(2 * np.pi))
    assert np.allclose(curve["density"], want, rtol=1e-8, atol=1e-11) and np.allclose(curve["x"], grid)
    many = spark.range(1_000_000).select((F.sqrt("id") * F.pi()).alias("x"))
    plan = st.kde_curve(many, "x")._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in plan and "MapInArrow" in plan
    assert abs(st.kde_curve(many, "x").selectExpr("sum(density) * (max(x) - min(x)) / 199 AS area").first()["area"] - 1) < 0.02


def test_nan_is_missing_in_histograms_and_quantiles(spark):
    some = spark.createDataFrame([(float(v),) for v in range(11)], "x DOUBLE")
    more = some.unionByName(spark.createDataFrame([(float("nan"),), (None,)], "x DOUBLE"))
    assert st.auto_histogram(some, "x", 5).collect() == st.auto_histogram(more, "x", 5).collect()
    assert st.quantile_histogram(some, "x", 0.9, 5).collect() == st.quantile_histogram(more, "x", 0.9, 5).collect()

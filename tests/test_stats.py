"""Histograms, curves, filters and dense-vector statistics."""

from __future__ import annotations

import numpy as np
import pytest

from loomset.operators import dense as dn
from loomset.operators import stats as st


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x DOUBLE").repartition(3)


@pytest.mark.parametrize("values", [range(101), [3, 3, 3], [0, 0.1, 0.2, 0.3, 0.7, 1.0], np.arange(1000) / 7])
def test_auto_histogram_matches_numpy(spark, values):
    got = st.auto_histogram(column(spark, values), "x").collect()
    want, edges = np.histogram(np.array(list(values), dtype=float), bins=50)
    assert [r["n"] for r in got] == want.tolist()
    assert [r["bin_start"] for r in got] + [got[-1]["bin_end"]] == pytest.approx(edges.tolist())


def test_quantile_histogram_leaves_out_the_top(spark):
    values = list(range(200)) + [10_000]
    got = st.quantile_histogram(column(spark, values), "x", 0.99).collect()
    top = np.quantile(values, 0.99)
    want, _ = np.histogram(values, bins=50, range=(0, top))
    assert [r["n"] for r in got] == want.tolist() and got[-1]["bin_end"] == pytest.approx(top)


def test_histogram_of_zeros(spark):
    got = st.quantile_histogram(column(spark, [0, 0, 0]), "x").collect()
    assert len(got) == 50 and sum(r["n"] for r in got) == 3


def test_kde_matches_direct_formula(spark):
    values = np.array([1.0, 2.0, 2.0, 5.0, 9.0])
    got = st.kde_curve(column(spark, values), "x").collect()
    at = np.linspace(1, 9, 200)
    h = values.std(ddof=1) * len(values) ** -0.2
    want = np.exp(-0.5 * ((at[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert [r["x"] for r in got] == pytest.approx(at.tolist())
    assert [r["density"] for r in got] == pytest.approx(want.tolist())
    assert [r["scaled"] for r in got] == pytest.approx((want * 5 * 8 / 50).tolist())


def test_outlier_filter_is_strict(spark):
    got = st.quantile_outlier_filter(column(spark, [1] * 20), "x").collect()
    assert got == []
    assert st.quantile_outlier_filter(column(spark, range(101)), "x").count() == 95


def test_max_scaled(spark):
    got = sorted(r["scaled"] for r in st.max_scaled(column(spark, [1, 2, 4]), "x").collect())
    assert got == [63.75, 127.5, 255.0]
    assert [r["scaled"] for r in st.max_scaled(column(spark, [0, 0]), "x").collect()] == [None, None]


def test_pixel_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([([0, 10, 255, 0, 10, 254],)], "p ARRAY<INT>")
    got = {(r["channel"], r["value"]): r["n"] for r in dn.pixel_histogram(df, "p").collect()}
    assert len(got) == 768 and sum(got.values()) == 6
    assert got[(0, 0)] == 2 and got[(1, 10)] == 2 and got[(2, 255)] == 1 and got[(2, 0)] == 0
    means = {r["channel"]: r["mean"] for r in dn.channel_means(df, "p").collect()}
    assert means == {0: 0.0, 1: 10.0, 2: 254.5}


def test_class_means_and_similarity(spark):
    rows = [(0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k INT, v ARRAY<FLOAT>").repartition(3)
    means = dn.class_mean_vector(df, "k", "v")
    assert {r["k"]: r["vector"] for r in means.collect()} == {0: [2.0, 0.0], 1: [1.0, 1.0], 2: [0.0, 0.0]}
    sim = {(r["a"], r["b"]): r["similarity"] for r in dn.class_similarity(means, "k").collect()}
    assert sim[(0, 1)] == pytest.approx(2**-0.5) and sim[(1, 1)] == pytest.approx(1)
    assert sim[(0, 2)] == sim[(2, 2)] == 0


def test_kde_of_a_constant_and_of_missing_values(spark):
    flat = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x DOUBLE")
    assert {r["density"] for r in st.kde_curve(flat, "x").collect()} == {None}
    some = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x DOUBLE")
    more = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "x DOUBLE")
    assert st.kde_curve(some, "x").collect() == st.kde_curve(more, "x").collect()

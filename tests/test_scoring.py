"""Vector expressions, class scores, zero-shot and probes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import vectors as vx
from loomset.operators import probe as pb
from loomset.operators import scoring as sc

RNG = np.random.default_rng(3)
X = RNG.normal(size=(30, 6))
W = RNG.normal(size=(5, 6))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)] + [(30, [0.0] * 6), (31, None)]
    return spark.createDataFrame(rows, "id INT, v ARRAY<FLOAT>").repartition(3)


@pytest.fixture(scope="module")
def heads(spark):
    rows = [(f"c{i}", [float(v) for v in w], float(i)) for i, w in enumerate(W)]
    return spark.createDataFrame(rows, "c STRING, w ARRAY<DOUBLE>, b DOUBLE")


def cosines():
    return (X / np.linalg.norm(X, axis=1, keepdims=True)) @ (W / np.linalg.norm(W, axis=1, keepdims=True)).T


@pytest.mark.parametrize("limit", [4096, 2])
def test_cosine_scores_by_matrix_and_by_grid(items, heads, limit):
    got = {r["id"]: r["scores"] for r in sc.class_scores(items, "id", "v", heads, "c", "w", 3.0, max_classes=limit).collect()}
    assert len(got) == 32
    for i in range(30):
        assert got[i] == pytest.approx((3 * cosines()[i]).tolist(), abs=1e-5)
    assert got[30] == [0.0] * 5
    assert got[31] is None


@pytest.mark.parametrize("limit", [4096, 2])
def test_uneven_null_and_repeated_vectors(spark, heads, limit):
    good, other = [float(v) for v in X[0]], [float(v) for v in X[1]]
    rows = [(1, good), (1, other), (1, other), (2, good[:3]), (3, [*good, 1.0]), (4, [None, *good[1:]]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "id INT, v ARRAY<DOUBLE>").repartition(1)
    got = sc.class_scores(df, "id", "v", heads, "c", "w", cosine=False, max_classes=limit).collect()
    assert len(got) == 8
    for r in got:
        if r["id"] == 1:
            assert r["scores"] == pytest.approx((W @ np.array(r["v"])).tolist())
        else:
            assert r["scores"] is None


@pytest.mark.parametrize("limit", [4096, 2])
def test_linear_head(items, heads, limit):
    rows = items.where("id < 30")
    scored = sc.class_scores(rows, "id", "v", heads, "c", "w", bias="b", cosine=False, max_classes=limit)
    want = X @ W.T + np.arange(5)
    for r in scored.collect():
        assert r["scores"] == pytest.approx(want[r["id"]].tolist(), abs=1e-5)


def test_no_class_vectors(items, heads):
    with pytest.raises(ValueError):
        sc.class_scores(items, "id", "v", heads.where("false"), "c", "w")


def test_zero_shot_modes(spark, heads):
    rows = [(i, [float(v) for v in x], [float(v) for v in -x]) for i, x in enumerate(X)] + [(99, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id INT, a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = sc.zero_shot_predict(df, "id", "a", "b", heads, heads, "c", "w", scale=5.0).collect()
    assert len(got) == 31
    half = next(r for r in got if r["id"] == 99)
    assert half["probs_image_only"] is None and half["pred_multimodal"] is None and len(half["pred_text_only"]) == 5
    got = [r for r in got if r["id"] != 99]

    def soft(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    image, text = soft(5 * cosines()), soft(-5 * cosines())
    for r in got:
        i = r["id"]
        assert r["probs_image_only"] == pytest.approx(image[i].tolist(), abs=1e-5)
        assert r["probs_text_only"] == pytest.approx(text[i].tolist(), abs=1e-5)
        assert r["probs_multimodal"] == pytest.approx(((image[i] + text[i]) / 2).tolist(), abs=1e-5)
        assert sum(r["probs_multimodal"]) == pytest.approx(1)
        assert r["pred_multimodal"] == [int(p > 0.1) for p in r["probs_multimodal"]]
    assert sc.by_mode(sc.zero_shot_predict(df, "id", "a", "b", heads, heads, "c", "w", 5.0), ["id"]).count() == 91


def test_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    a, b = F.col("a"), F.col("b")
    r = df.select(
        vx.softmax(a).alias("s"),
        vx.softmax(F.transform(a, lambda x: x + 1000)).alias("big"),
        vx.cosine(a, a).alias("one"),
        vx.cosine(a, b).alias("zero"),
        vx.argmax(b).alias("first"),
        vx.log_sum_exp(F.transform(a, lambda x: x + 1000)).alias("lse"),
        vx.unit(b).alias("unit"),
        F.transform(F.array(F.lit(-800.0), F.lit(0.0), F.lit(800.0)), vx.sigmoid).alias("sig"),
        vx.threshold_all(F.array(F.lit(0.1), F.lit(0.11)), 0.1).alias("t"),
        vx.fuse_concat(a, b).alias("cat"),
    ).first()
    e = np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()
    assert r["s"] == pytest.approx(e.tolist()) and r["big"] == pytest.approx(e.tolist())
    assert r["one"] == pytest.approx(1) and r["zero"] == 0 and r["first"] == 0
    assert r["lse"] == pytest.approx(1000 + np.log(np.exp([1, 2, 3]).sum()))
    assert r["unit"] == [0, 0, 0] and r["sig"] == [0.0, 0.5, 1.0] and r["t"] == [0, 1]
    assert r["cat"] == [1, 2, 3, 0, 0, 0]


def test_map_batches(spark):
    df = sc.map_batches(spark.range(50), lambda b: b.assign(y=b["id"] * 2), "id BIGINT, y BIGINT")
    assert all(r["y"] == 2 * r["id"] for r in df.collect())


@pytest.fixture(scope="module")
def separable(spark):
    rows = []
    for i in range(120):
        k = i % 3
        noise = RNG.normal(scale=0.1, size=4).tolist()
        rows.append((i, [float(k == 0) + noise[0], float(k == 1) + noise[1]], [float(k == 2) + noise[2], noise[3]], k,
                     [int(k == 0), int(k != 0), 0]))
    return spark.createDataFrame(rows, "id INT, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, k INT, y_true ARRAY<INT>")


def test_probe_modes(separable):
    got = pb.linear_probe(separable, separable, "a", "b", "k", ["id"], passes=20)
    rates = {
        r["mode"]: r["ok"] for r in got.groupBy("mode").agg(F.avg((F.col("k") == F.col("y_pred")).cast("int")).alias("ok")).collect()
    }
    assert rates["multimodal"] > 0.95 and rates["image_only"] > 0.8 and set(rates) == set(sc.MODES)


def test_probe_with_hidden_layer(separable):
    got = pb.probe_single(separable, separable, F.concat("a", "b"), "k", passes=100, hidden=8)
    assert got.where("k = y_pred").count() > 100


def test_probe_multilabel_with_empty_class(separable):
    got = pb.probe_multilabel(separable, separable, F.concat("a", "b"), "y_true", 3, cut=0.5, passes=20)
    same = got.where("y_true = y_pred").count()
    assert same > 110 and got.where("y_pred[2] = 1").count() == 0

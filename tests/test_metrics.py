"""Evaluation operators against direct formulas."""

from __future__ import annotations

import numpy as np
import pytest

from loomset.operators import metrics as mt

RNG = np.random.default_rng(5)
T = (RNG.random((40, 4)) < [0.5, 0.2, 0.8, 0.0]).astype(int)
P = (RNG.random((40, 4)) < [0.5, 0.3, 0.7, 0.0]).astype(int)


@pytest.fixture(scope="module")
def multi(spark):
    rows = [(i, "m", t.tolist(), p.tolist(), [float(v) for v in (2 * p - 1)]) for i, (t, p) in enumerate(zip(T, P))]
    return spark.createDataFrame(
        rows, "id INT, mode STRING, y_true ARRAY<INT>, y_pred ARRAY<INT>, logits ARRAY<DOUBLE>"
    ).repartition(3)


def f1s():
    tp, fp, fn = (T & P).sum(0), ((1 - T) & P).sum(0), (T & (1 - P)).sum(0)
    per = [2 * a / (2 * a + b + c) if 2 * a + b + c else 0.0 for a, b, c in zip(tp, fp, fn)]
    return 2 * tp.sum() / (2 * tp.sum() + fp.sum() + fn.sum()), float(np.mean(per))


def test_multilabel_scores(multi):
    micro, macro = f1s()
    subset, hamming = (T == P).all(1).mean(), (T == P).mean()
    assert mt.micro_f1(multi).first()[0] == pytest.approx(micro)
    assert mt.macro_f1(multi).first()[0] == pytest.approx(macro)
    assert mt.subset_accuracy(multi).first()[0] == pytest.approx(subset)
    assert mt.hamming_accuracy(multi).first()[0] == pytest.approx(hamming)
    for r in (mt.multilabel_scores(multi).first(), mt.multilabel_scores(multi, ["mode"]).first()):
        assert (r["micro_f1"], r["macro_f1"]) == pytest.approx((micro, macro))
        assert (r["subset_acc"], r["hamming_acc"]) == pytest.approx((subset, hamming))


def test_report(multi, spark):
    classes = spark.createDataFrame([(["a", "b", "c", "d"],)], "classes ARRAY<STRING>")
    got = {r["label"]: r for r in mt.classification_report(multi, classes).collect()}
    assert len(got) == 8
    assert got["d"]["f1"] == got["d"]["precision"] == 0 and got["d"]["support"] == 0
    micro, macro = f1s()
    assert got["micro avg"]["f1"] == pytest.approx(micro) and got["macro avg"]["f1"] == pytest.approx(macro)
    support = T.sum(0)
    weighted = sum(got[k]["f1"] * s for k, s in zip("abcd", support)) / support.sum()
    assert got["weighted avg"]["f1"] == pytest.approx(weighted)
    hit, true, pred = (T & P).sum(1), T.sum(1), P.sum(1)
    samples = np.mean([2 * h / (t + p) if t + p else 0 for h, t, p in zip(hit, true, pred)])
    assert got["samples avg"]["f1"] == pytest.approx(samples) and got["samples avg"]["support"] == support.sum()


SINGLE = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "a"), ("d", "d")]


@pytest.fixture(scope="module")
def single(spark):
    return spark.createDataFrame(SINGLE + [("a", "e")], "t STRING, p STRING")


def test_confusion_matrix_has_zero_cells(single):
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in mt.confusion_matrix(single, "t", "p").collect()}
    assert len(got) == 25 and sum(got.values()) == 7
    assert got[("a", "a")] == 2 and got[("e", "a")] == 0 and got[("a", "e")] == 1


def test_errors_and_single_scores(single):
    got = {r["label"]: (r["fn"], r["fp"]) for r in mt.errors_per_class(single, "t", "p").collect()}
    assert got == {"a": (2, 1), "b": (0, 1), "c": (1, 0), "d": (0, 0), "e": (0, 1)}
    accuracy = mt.accuracy(single, "t", "p").first()[0]
    scores = mt.single_label_f1(single, "t", "p").first()
    assert accuracy == pytest.approx(4 / 7) == pytest.approx(scores["f1_micro"])
    assert scores["f1_macro"] == pytest.approx(np.mean([4 / 7, 2 / 3, 0, 1, 0]))


@pytest.mark.parametrize("wrong", [False, True])
def test_extreme_predictions(spark, wrong):
    rows = [([1, 0], [0, 1] if wrong else [1, 0]), ([0, 1], [1, 0] if wrong else [0, 1])]
    r = mt.multilabel_scores(spark.createDataFrame(rows, "y_true ARRAY<INT>, y_pred ARRAY<INT>")).first()
    want = 0.0 if wrong else 1.0
    assert (r["micro_f1"], r["macro_f1"], r["subset_acc"], r["hamming_acc"]) == (want,) * 4


def test_bce_batches_differ_from_rows(spark):
    rows = [([10.0], [1], 0), ([10.0], [1], 0), ([-3.0], [1], 1)]
    df = spark.createDataFrame(rows, "logits ARRAY<DOUBLE>, y_true ARRAY<INT>, batch INT")
    r = mt.bce_loss(df, batch="batch").first()
    low, high = np.log1p(np.exp(-10.0)), np.log1p(np.exp(3.0))
    assert r["row_mean"] == pytest.approx((2 * low + high) / 3)
    assert r["batch_mean"] == pytest.approx((low + high) / 2)
    assert mt.bce_loss(df).first()["row_mean"] == pytest.approx((2 * low + high) / 3)


def test_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([1000.0, 0.0], 0)], "z ARRAY<DOUBLE>, y INT")
    assert mt.cross_entropy_loss(df, "z", "y").first()[0] == pytest.approx(np.log1p(np.e) / 2)


def test_best_epoch(spark):
    rows = [("a", 1, 0.5, 9), ("a", 2, 0.7, 8), ("a", 3, 0.7, 7), ("b", 1, 0.0, 1), ("c", 1, 0.1, 2)]
    df = spark.createDataFrame(rows, "run STRING, epoch INT, score DOUBLE, extra INT")
    got = {tuple(r) for r in mt.best_epoch(df, "run", "epoch", "score").collect()}
    assert got == {("a", 2, 0.7, 8), ("c", 1, 0.1, 2)}
    assert {r[0]: r[1] for r in mt.epoch_time_mean(df, "run", "extra").collect()} == {"a": 8, "b": 1, "c": 2}
    assert mt.epoch_loss_mean(df, "run", "epoch", "score").count() == 5

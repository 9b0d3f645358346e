"""The chained analyses on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset import workflows as wf


def test_text_eda(spark):
    rows = [("x", "red cat and red cat"), ("x", "the cat"), ("y", "blue dog blue dog"), ("y", "")]
    out = wf.text_eda(spark.createDataFrame(rows, "label STRING, body STRING"), "label", "body")
    assert [tuple(r) for r in out["class_distribution"].collect()] == [("x", 2), ("y", 2)]
    assert [r["unique_words"] for r in out["vocabulary_richness"].collect()] == [2, 2]
    top = {(r["category"], r["rank"]): r["term"] for r in out["top_terms"].collect()}
    assert top[("x", 1)] == "cat" and set(top.values()) == {"cat", "red", "blue", "dog"}
    assert out["top_bigrams"].first()["bigram"] == "red cat"
    similar = {(r["a"], r["b"]): r["similarity"] for r in out["class_similarity"].collect()}
    assert similar[("x", "y")] == 0 and similar[("y", "y")] == pytest.approx(1)
    assert out["word_count_histogram"].count() == 50


def test_prepare_multimodal(spark):
    def chat(i):
        parts = [("user", f"T. Plot: story {i}"), ("assistant", "Drama, Action" if i % 2 else "Drama")]
        return parts[: 1 if i == 7 else 2]

    rows = [(i, chat(i), f"movie_{i:05d}.jpg") for i in range(21)]
    df = spark.createDataFrame(rows, "id INT, messages ARRAY<STRUCT<role: STRING, content: STRING>>, image STRING")
    out = wf.prepare_multimodal(df, "id", "messages", "image")
    assert [tuple(r) for r in out["rejects"].collect()] == [(7, "no labels")]
    assert out["classes"].first()["classes"] == ["Action", "Drama"]
    parts = {r["split"]: r["count"] for r in out["rows"].groupBy("split").count().collect()}
    assert parts == {"train": 16, "val": 2, "test": 2}
    assert {tuple(r["labels_binary"]) for r in out["rows"].collect()} == {(0, 1), (1, 1)}
    assert tuple(out["label_summary"].first())[:2] == (20, 2)
    assert out["label_correlation"].count() == 4


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    base = np.eye(3)
    rows = []
    for i in range(200):
        k = i % 3
        rows.append((i, (base[k] + rng.normal(scale=0.2, size=3)).tolist(), (base[k] + rng.normal(scale=0.2, size=3)).tolist(),
                     base[k].astype(int).tolist()))
    items = spark.createDataFrame(rows, "id INT, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, y ARRAY<INT>")
    classes = spark.createDataFrame([(f"c{k}", base[k].tolist()) for k in range(3)], "c STRING, w ARRAY<DOUBLE>")
    return items, classes


def test_zero_shot_evaluation(pairs):
    items, classes = pairs
    out = wf.evaluate_zero_shot(items, "id", "a", "b", "y", classes, "c", "w", scale=10.0, cut=0.5, sample=50)
    assert out["predictions"].count() == 150
    rows = out["comparison"].collect()
    assert [r["mode"] for r in rows] == ["image_only", "text_only", "multimodal"]
    assert all(r["micro_f1"] > 0.9 for r in rows)
    report = {r["label"]: r["support"] for r in out["report"].collect()}
    assert report["micro avg"] == 50 and set(report) >= {"c0", "c1", "c2", "samples avg"}
    every = wf.evaluate_zero_shot(items, "id", "a", "b", "y", classes, "c", "w", 10.0, 0.5, sample=None)
    assert every["predictions"].select(F.count_distinct("id")).first()[0] == 200


def test_few_shot_experiment(pairs):
    items, _ = pairs
    rows = wf.few_shot_experiment(items, "id", "a", "b", "y", 3, fraction=0.3, cut=0.5, passes=10).collect()
    assert [r["mode"] for r in rows] == ["image_only", "text_only", "multimodal"]
    assert all(r["hamming_acc"] > 0.9 for r in rows)

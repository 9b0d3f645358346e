"""Bitmaps of labels and bounded summaries against plain counts."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomset.operators import heavy_hitters as hh
from loomset.operators import label_bitmaps as bm


def label_rows(n, labels, most, seed=1):
    rng = random.Random(seed)
    rows = [[f"l{min(rng.randrange(labels), rng.randrange(labels)):03d}" for _ in range(rng.randrange(most))] for _ in range(n)]
    return [*rows, None, [], ["l000", "l000", None], [None]]


@pytest.mark.parametrize(("cells", "pairs"), [(bm.BLOCK_CELLS, bm.MAX_PAIRS), (100, 7)])
def test_bitmaps_count_the_same_pairs(spark, monkeypatch, cells, pairs):
    monkeypatch.setattr(bm, "BLOCK_CELLS", cells)
    monkeypatch.setattr(bm, "MAX_PAIRS", pairs)
    rows = label_rows(300, 40, 25)
    want = Counter()
    for row in rows:
        own = {x for x in row or [] if x is not None}
        want.update((a, b) for a in own for b in own)
    df = spark.createDataFrame([(r,) for r in rows], "labels ARRAY<STRING>").repartition(3)
    got = {(r["a"], r["b"]): r["n_ab"] for r in bm.cooccurrence_by_bitmaps(df, "labels").collect()}
    assert got == dict(want)
    assert not bm.cooccurrence_by_bitmaps(df.where("labels IS NULL"), "labels").collect()


def test_rows_of_two_thousand_labels(spark):
    wide = spark.range(400).select(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit("l"), i.cast("string"))).alias("labels"))
    found = bm.cooccurrence_by_bitmaps(wide, "labels").agg(F.count(F.lit(1)), F.min("n_ab"), F.max("n_ab")).first()
    assert tuple(found) == (2000 * 2000, 400, 400)


def plain_top(rows, k):
    counts = {}
    for group, items in rows:
        counts.setdefault(group, Counter()).update(x for x in items or [] if x is not None)
    out = set()
    for group, own in counts.items():
        for rank, (item, n) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((group, item, n, rank))
    return out


@pytest.mark.parametrize("capacity", [1, 20, 10_000])
@pytest.mark.parametrize("flat", [False, True])
def test_top_counts_are_exact_at_any_capacity(spark, capacity, flat):
    rng = random.Random(3)
    draw = (lambda: rng.randrange(150)) if flat else (lambda: int(rng.paretovariate(0.7)) % 4000)
    rows = [(rng.choice(["x", "y", None]), [f"i{draw()}" for _ in range(rng.randrange(40))]) for _ in range(300)]
    rows += [("z", ["only", None]), ("w", None), ("v", [])]
    df = spark.createDataFrame(rows, "g STRING, items ARRAY<STRING>").repartition(4)
    got = hh.top_counts(df, "g", F.col("items"), "item", k=5, capacity=capacity)
    assert set(map(tuple, got.collect())) == plain_top(rows, 5)


def test_what_is_shuffled_is_bounded_by_the_capacity():
    summary = hh._Summary(10)
    rng = random.Random(2)
    true = Counter()
    for _ in range(500):
        items = [f"i{int(rng.paretovariate(0.6))}" for _ in range(20)]
        true.update(items)
        summary.add(items)
        assert len(summary.counts) <= 40
    assert summary.missed > 0
    for item, n in true.items():
        assert summary.counts[item] <= n <= summary.counts[item] + summary.missed


def test_sparse_similarity_of_many_classes(spark):
    import numpy as np

    from loomset.operators.sparse_product import sparse_class_similarity

    rng = np.random.default_rng(6)
    dense = rng.random((60, 30)) * (rng.random((60, 30)) < 0.15)
    dense[7] = 0
    rows = [(f"c{i:02d}", f"t{j}", float(dense[i, j])) for i in range(60) for j in range(30) if dense[i, j] or j == 3]
    df = spark.createDataFrame([*rows, ("c01", "t29x", None)], "c STRING, t STRING, w DOUBLE").repartition(5)
    want = {}
    for a in range(60):
        for b in range(60):
            if (dense[a] * dense[b]).any():
                want[f"c{a:02d}", f"c{b:02d}"] = dense[a] @ dense[b] / np.linalg.norm(dense[a]) / np.linalg.norm(dense[b])
    for block in (1024, 4):
        got = {(r["a"], r["b"]): r["similarity"] for r in sparse_class_similarity(df, "c", "t", "w", block).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    many = spark.range(150_000).select(F.floor(F.col("id") / 3).alias("c"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("t"), F.lit(1.0).alias("w"))
    many = many.distinct()
    own = sparse_class_similarity(many, "c", "t", "w").where("a = b")
    assert own.where("abs(similarity - 1) < 1e-9").count() == 50_000


def test_empty_tables_give_empty_results(spark):
    from loomset.operators import tfidf as ti

    docs = spark.createDataFrame([], "id INT, k STRING, tokens ARRAY<STRING>")
    model = ti.fit_tfidf(docs, "tokens")
    assert model.terms == [] and not ti.tfidf_weights(docs, model, "id", "tokens").collect()
    blank = spark.createDataFrame([(1, "x", [])], docs.schema)
    model = ti.fit_tfidf(blank, "tokens")
    assert not ti.tfidf_weights(blank, model, "id", "tokens").collect()
    means = ti.class_mean_vectors(blank, model, "k", "tokens")
    assert [tuple(r) for r in means.collect()] == [("x", [])] and not ti.class_mean_weights(means, model, "k").collect()

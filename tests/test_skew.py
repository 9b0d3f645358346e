"""One class, token or value holds a third of the rows or more; results stay whole."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomset.operators import corpus as cp
from loomset.operators import labels as lb
from loomset.operators import metrics as mt
from loomset.operators import splits as sp
from loomset.operators import tfidf as ti
from loomset.operators import vocab as vc
from loomset.plans.sizes import distinct_at_most, spread_small

N = 3000
CLASSES = ["big" if i % 3 else f"c{i % 30}" for i in range(N)]
TOKENS = [["the"] * (i % 5) + [f"w{i % 37}", f"w{i % 11}"] for i in range(N)]


@pytest.fixture(scope="module", params=["true", "false"], ids=["adaptive", "static"])
def table(spark, request):
    """The checks hold with and without adaptive execution."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    rows = [(i, CLASSES[i], TOKENS[i]) for i in range(N)]
    yield spark.createDataFrame(rows, "id INT, k STRING, t ARRAY<STRING>").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_richness_and_bigrams(table):
    want = {k: {t for c, toks in zip(CLASSES, TOKENS) if c == k for t in toks} for k in set(CLASSES)}
    got = {r["k"]: r["unique_words"] for r in cp.vocabulary_richness(table, "k", "t").collect()}
    assert got == {k: len(v) for k, v in want.items()}
    pairs = Counter(f"{a} {b}" for c, toks in zip(CLASSES, TOKENS) if c == "big" for a, b in zip(toks, toks[1:]))
    best = sorted(pairs, key=lambda p: (-pairs[p], p))[:5]
    top = [(r["bigram"], r["n"]) for r in cp.top_bigrams(table, "k", "t").where("k = 'big'").collect()]
    assert top == [(p, pairs[p]) for p in best]


def test_top_k_is_cut_before_the_shuffle(table):
    counts = table.groupBy("k", "id").count()
    plan = cp.top_per_group(counts, "k", [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_class_means_are_built_before_the_shuffle(table):
    model = ti.fit_tfidf(table, "t", 20)
    plan = ti.class_mean_vectors(table, model, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "partial_aggregate_metrics" in plan


def test_stratified_takes_the_share_of_the_big_class(table):
    got = Counter(r["k"] for r in sp.stratified_sample(table, "id", "k", 300).collect())
    sizes = Counter(CLASSES)
    assert sum(got.values()) == 300
    assert all(abs(got[k] - 300 * n / N) < 1 for k, n in sizes.items())


@pytest.mark.parametrize("limit", [10_000, 0])
def test_hot_token_lookup(table, limit):
    vocab = table.sparkSession.createDataFrame(
        [("<pad>", 0, 0), ("<unk>", 1, 0), ("the", 2, N)] + [(f"w{i}", i + 3, 1) for i in range(30)],
        "token STRING, id BIGINT, n_docs BIGINT",
    )
    rows = table.select("id", F.explode("t").alias("token"))
    found = vc.vocab_lookup(rows, vocab, max_entries=limit, hot_tokens=1)
    got = {(r["token"], r["token_id"]): r["count"] for r in found.groupBy("token", "token_id").count().collect()}
    want = Counter(t for toks in TOKENS for t in toks)
    ids = {"the": 2, **{f"w{i}": i + 3 for i in range(30)}}
    assert got == {(t, ids.get(t, 1)): n for t, n in want.items()}


def test_cooccurrence_shuffles_pairs_not_rows(table):
    got = {(r["a"], r["b"]): r["n_ab"] for r in lb.label_cooccurrence(table, "t").collect()}
    want = Counter((a, b) for toks in TOKENS for a in set(toks) for b in set(toks))
    assert got == dict(want)
    plan = lb.label_cooccurrence(table, "t")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Join" not in plan


def test_best_row_of_a_hot_run(table):
    runs = table.select(F.col("k").alias("run"), F.col("id").alias("epoch"), (F.col("id") % 50 / 50).alias("score"))
    got = {r["run"]: r["epoch"] for r in mt.best_epoch(runs, "run", "epoch", "score").collect()}
    for k in set(CLASSES):
        ids = [i for i in range(N) if CLASSES[i] == k]
        assert got.get(k) == (min(ids, key=lambda i: (-(i % 50), i)) if any(i % 50 for i in ids) else None)


def test_size_checks(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7).coalesce(1)
    assert distinct_at_most(df, "k", 7) and not distinct_at_most(df, "k", 6)
    assert spread_small(df, 100).rdd.getNumPartitions() > 1
    assert spread_small(df, 99).rdd.getNumPartitions() == 1

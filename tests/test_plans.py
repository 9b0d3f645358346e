"""Ranking, quantile and pair plans against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import splits as sp
from loomset.plans.pairs import grid_pairs
from loomset.plans.quantiles import exact_quantile
from loomset.plans.ranking import global_index, hash_rank


def ordered(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def frame(spark, n):
    return spark.range(n).repartition(4)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 500])
def test_three_way_split(spark, n):
    got = {r["id"]: r["split"] for r in sp.split_train_val_test(frame(spark, n), "id").collect()}
    order = ordered(range(n))
    held = int(np.ceil(0.2 * n))
    test = int(np.ceil(0.5 * held))
    want = ["train"] * (n - held) + ["val"] * (held - test) + ["test"] * test
    assert [got[i] for i in order] == want


@pytest.mark.parametrize("n", [1, 10, 33])
def test_two_way_splits(spark, n):
    order = ordered(range(n))
    got = {r["id"]: r["split"] for r in sp.split_train_val(frame(spark, n), "id").collect()}
    assert [got[i] for i in order] == ["train"] * int(0.9 * n) + ["val"] * (n - int(0.9 * n))
    got = {r["id"]: r["split"] for r in sp.split_held_out(frame(spark, n), "id").collect()}
    assert sum(v == "val" for v in got.values()) == int(np.ceil(0.2 * n))


def test_split_does_not_depend_on_partitions(spark):
    one = {tuple(r) for r in sp.split_train_val_test(spark.range(300).coalesce(1), "id").collect()}
    many = {tuple(r) for r in sp.split_train_val_test(spark.range(300).repartition(7), "id").collect()}
    other = {tuple(r) for r in sp.split_train_val_test(spark.range(300), "id", seed=7).collect()}
    assert one == many != other


def test_split_moves_no_row(spark):
    df = sp.split_train_val_test(spark.range(300).withColumn("wide", F.repeat(F.lit("x"), 100)), "id")
    main = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main


@pytest.mark.parametrize("k", [0, 1, 7, 40, 100])
def test_fixed_size_sample(spark, k):
    got = {r["id"] for r in sp.fixed_size_sample(frame(spark, 40), "id", k).collect()}
    assert got == set(ordered(range(40))[:k])


def test_few_shot_is_part_of_train(spark):
    got = {r["id"] for r in sp.few_shot_sample(frame(spark, 500), "id").collect()}
    assert got == set(ordered(range(500))[:20])


def test_stratified_quotas(spark):
    labels = ["a"] * 70 + ["b"] * 20 + ["c"] * 9 + ["d"]
    df = spark.createDataFrame(list(enumerate(labels)), "id INT, label STRING").repartition(5)
    for size, want in [(10, {"a": 7, "b": 2, "c": 1}), (50, {"a": 35, "b": 10, "c": 5}), (100, None), (500, None)]:
        rows = sp.stratified_sample(df, "id", "label", size).collect()
        counts = {}
        for r in rows:
            counts[r["label"]] = counts.get(r["label"], 0) + 1
        assert counts == (want or {"a": 70, "b": 20, "c": 9, "d": 1})
        for label, n in counts.items():
            ids = [i for i, x in enumerate(labels) if x == label]
            assert {r["id"] for r in rows if r["label"] == label} == set(ordered(ids)[:n])


def test_batches(spark):
    rows = sp.shuffle_batches(frame(spark, 70), "id", 32).collect()
    order = ordered(range(70))
    assert {r["id"]: r["batch_id"] for r in rows} == {i: k // 32 for k, i in enumerate(order)}
    assert {r["batch_id"] for r in sp.shuffle_batches(frame(spark, 5), "id", 32).collect()} == {0}


def test_hash_rank(spark):
    got = {r["id"]: r["rank"] for r in hash_rank(frame(spark, 3000), "id").collect()}
    assert [got[i] for i in ordered(range(3000))] == list(range(1, 3001))


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    got = global_index(df, ["x"], "i").collect()
    assert all(r["i"] == r["x"] for r in got) and len(got) == 1000


def test_grid_pairs_are_all_pairs(spark):
    left = spark.range(23).withColumnRenamed("id", "a")
    right = spark.range(11).withColumnRenamed("id", "b")
    got = [(r["a"], r["b"]) for r in grid_pairs(left, right, "a", "b").collect()]
    assert len(got) == 23 * 11 and len(set(got)) == 23 * 11
    plan = grid_pairs(left, right, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def heavy(n):
    return [5.0] * (n // 3) + [float(i % 97) / 7 for i in range(n - n // 3)]


@pytest.mark.parametrize(
    "values",
    [
        [float(i * i % 1009) for i in range(3000)],
        [3.0] * 2000,
        heavy(3000),
        [0.0] * 1500 + [1.0] * 1500,
        [float(2**i) for i in range(60)] * 20,
    ],
)
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 0.99, 1.0])
def test_quantile_search_is_exact(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x DOUBLE")
    got = exact_quantile(df, "x", q, exact_rows=10).first()[0]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "x DOUBLE"), "x", 0.5).first()[0] is None


def test_task_functions_travel_with_their_code():
    """Workers start in another folder than the driver and have no copy of the packages."""
    import registry  # noqa: F401
    from pyspark import cloudpickle

    assert {"loomset", "registry"} <= set(cloudpickle.list_registry_pickle_by_value())

"""Collated batches and largest remainders over many labels."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from loomset.operators import splits as sp
from loomset.operators.batches import collate_batches


def test_a_batch_is_as_wide_as_its_longest_row(spark):
    rows = [(0, 5, [1, 2, 3]), (0, 4, []), (0, 6, None), (1, 7, [9]), (2, 8, None), (None, 9, [1] * 50)]
    df = spark.createDataFrame(rows, "b BIGINT, id INT, ids ARRAY<INT>")
    got = {r["b"]: r for r in collate_batches(df, "b", "id", "ids").collect()}
    assert set(got) == {0, 1, 2}
    first = got[0]
    assert (first["n_rows"], first["width"], first["n_padding"]) == (3, 3, 6)
    assert first["row_ids"] == [4, 5, 6] and first["input_ids"] == [0, 0, 0, 1, 2, 3, 0, 0, 0]
    assert first["attention_mask"] == [0, 0, 0, 1, 1, 1, 0, 0, 0]
    assert got[1]["input_ids"] == [9] and got[1]["n_padding"] == 0
    assert (got[2]["width"], got[2]["input_ids"]) == (0, [])
    assert not collate_batches(df.where("id > 100"), "b", "id", "ids").collect()


def plain_quotas(counts, size):
    rows = sum(counts.values())
    base = {k: n * size // rows for k, n in counts.items()}
    order = sorted(counts, key=lambda k: (-(counts[k] * size % rows), k))
    more = set(order[: min(size, rows) - sum(base.values())])
    return {k: min(base[k] + (k in more), n) for k, n in counts.items()}


def quotas(df, size):
    return {r["label"]: r["quota"] for r in sp._quotas(df, "label", size).collect()}


def test_quotas_equal_plain_ones(spark):
    rng = random.Random(4)
    for labels, rows, size in ((7, 200, 50), (300, 1000, 100), (5, 60, 60), (3, 10, 40), (40, 40, 17), (1, 9, 4)):
        drawn = [f"k{min(rng.randrange(labels), rng.randrange(labels)):03d}" for _ in range(rows)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(drawn)], "id BIGINT, label STRING")
        want = plain_quotas(Counter(drawn), size)
        assert quotas(df, size) == want and sum(want.values()) == min(size, rows)
    assert quotas(df.where("id < 0"), 5) == {}


def test_a_million_labels_in_no_single_task(spark):
    many = spark.range(1_200_000).select("id", F.least("id", F.lit(999_999)).alias("label"))
    found = sp._quotas(many, "label", 600_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    by = {r["quota"]: (r["n"], r["lo"], r["hi"]) for r in found.groupBy("quota").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).collect()}
    # 999,999 labels of one row have the remainder 600,000; the last, with 200,001 rows, gets 100,000 and 600,000 over
    assert by[1] == (500_000, 0, 499_999) and by[0] == (499_999, 500_000, 999_998) and by[100_000][1] == 999_999

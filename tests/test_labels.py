"""Parsing and multi-label operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import parsing as ps
from loomset.operators import labels as lb
from loomset.operators.stats import decode

MESSAGES = "id INT, messages ARRAY<STRUCT<role: STRING, content: STRING>>"


def chat(*contents):
    return [("r", c) for c in contents]


CASES = [
    (0, chat("no marker here", "Drama, Action")),
    (1, chat("T. Plot:  one plot \nNote: x", "Drama, Action")),
    (2, chat("Plot: first Plot: second", "Drama ,Action,")),
    (3, chat("Plot: no note", "Drama")),
    (4, chat("Plot: one message only\nNote")),
    (5, []),
    (6, None),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(CASES, MESSAGES)


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_plot_last(messages):
    got = by_id(messages.select("id", ps.plot_last(ps.message(F.col("messages"), 0)).alias("p")), "p")
    assert got == {
        0: "no marker here", 1: " one plot \nNote: x", 2: "second", 3: "no note", 4: "one message only\nNote",
        5: None, 6: None,
    }


def test_strict_parser_nulls_both(messages):
    got = by_id(messages.select("id", ps.parse_strict(F.col("messages")).alias("p")), "p")
    assert {i: (p["plot"], p["genres"]) for i, p in got.items()} == {
        0: (None, None),
        1: ("one plot", ["Drama", "Action"]),
        2: ("first", ["Drama ,Action,"]),
        3: ("no note", ["Drama"]),
        4: (None, None),
        5: (None, None),
        6: (None, None),
    }


def test_genres_trim_keeps_empty_pieces(messages):
    got = by_id(messages.select("id", ps.genres_trim(ps.message(F.col("messages"), 1)).alias("g")), "g")
    assert got[2] == ["Drama", "Action", ""] and got[4] is None


def test_pipes(spark):
    df = spark.createDataFrame([(0, "a|b"), (1, ""), (2, None), (3, "a")], "id INT, g STRING")
    assert by_id(df.select("id", ps.pipe_split(F.col("g")).alias("x")), "x") == {0: ["a", "b"], 1: [], 2: [], 3: ["a"]}


def test_rejects_name_the_first_failed_check(spark):
    df = spark.createDataFrame([(0, 1), (1, -1), (2, None), (3, 200)], "id INT, x INT")
    good, bad = lb.split_rejects(df, "id", {"sign": F.col("x") > 0, "size": F.col("x") < 100})
    assert [r["id"] for r in good.collect()] == [0]
    assert by_id(bad, "reason") == {1: "sign", 2: "sign", 3: "size"}


LABELS = [(0, ["a", "b"]), (1, ["b", "b"]), (2, []), (3, None), (4, ["c", "b", "zz"])]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(LABELS, "id INT, g ARRAY<STRING>")


def test_counts_keep_duplicates(labelled):
    assert [tuple(r) for r in lb.label_counts(labelled, "g").collect()] == [("b", 4), ("a", 1), ("c", 1), ("zz", 1)]


def test_cardinality_and_summary(labelled):
    present = labelled.where("g IS NOT NULL")
    assert {tuple(r) for r in lb.label_cardinality_distribution(present, "g").collect()} == {(0, 1), (2, 2), (3, 1)}
    assert tuple(lb.label_summary(present, "g").first()) == (4, 4, 1.75)


def test_multi_hot_ignores_unknown_labels(labelled, spark):
    classes = lb.fit_classes(labelled.where("id < 2"), "g")
    assert classes.first()["classes"] == ["a", "b"]
    got = by_id(lb.multi_hot(labelled, "g", classes), "labels_binary")
    assert got == {0: [1, 1], 1: [0, 1], 2: [0, 0], 3: [0, 0], 4: [0, 1]}


def test_cooccurrence_is_symmetric(labelled):
    got = {(r["a"], r["b"]): r["n_ab"] for r in lb.label_cooccurrence(labelled, "g").collect()}
    assert got[("b", "b")] == 3 and got[("a", "b")] == got[("b", "a")] == 1 and ("a", "c") not in got
    assert len(got) == 4 + 2 * 4


def test_correlation_matches_numpy_and_constant_is_null(spark):
    rng = np.random.default_rng(1)
    hot = (rng.random((60, 4)) < [0.2, 0.5, 0.7, 2.0]).astype(int)
    rows = [(i, [f"k{j}" for j in range(4) if hot[i, j]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id INT, g ARRAY<STRING>")
    got = {(r["a"], r["b"]): r["correlation"] for r in lb.label_correlation(df, "g").collect()}
    want = np.corrcoef(hot[:, :3].T)
    assert len(got) == 16
    for i in range(4):
        for j in range(4):
            value = got[(f"k{i}", f"k{j}")]
            assert value is None if 3 in (i, j) else value == pytest.approx(want[i, j])


def test_decode_unknown(spark):
    df = spark.createDataFrame([(0,), (7,), (None,)], "x INT")
    assert [r[0] for r in df.select(decode(F.col("x"), {0: "zero"})).collect()] == ["zero", None, None]

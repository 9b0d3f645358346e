"""Wide columns are read after the joins: whole results, and no shuffle that holds them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from loomset.operators import images as im
from loomset.sources import images as src
from loomset.sources import late_fetch as lf
from loomset.sources.storage import shared_dir


@pytest.fixture
def store(spark, tmp_path):
    """Two files of several row groups; key 7 stands in both."""
    for name, ids in (("a", range(0, 60)), ("b", [7, *range(60, 100)])):
        table = pa.table({"key": [f"k{i:03d}" for i in ids], "data": [f"{name}{i}".encode() * (i % 5 + 1) for i in ids]})
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=9)
    return str(tmp_path)


def shuffled_types(df):
    """The column types of everything that is shuffled, joined or sorted in the plan."""
    found, open_nodes = [], [df._jdf.queryExecution().optimizedPlan()]
    while open_nodes:
        node = open_nodes.pop()
        children = node.children()
        open_nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() in ("RepartitionByExpression", "Join", "Sort", "Aggregate", "Window"):
            output = node.output()
            found.append([output.apply(i).dataType().typeName() for i in range(output.size())])
    return found


def want(key):
    i = int(key[1:])
    return f"{'a' if i < 60 else 'b'}{i}".encode() * (i % 5 + 1)


def test_lookup_reads_bytes_after_the_join(spark, store):
    images = spark.read.parquet(store)
    keys = [f"k{i:03d}" for i in range(0, 130, 3)] + ["k007"] * 300 + [None]
    rows = spark.createDataFrame(list(enumerate(keys)), "id INT, key STRING").repartition(6)
    found = src.lookup_with_fallback(rows, images, "key", width=2, height=1)
    assert found.columns == ["id", "key", "data", "is_fallback"]
    types = shuffled_types(found)
    assert types and all("binary" not in t for t in types)
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == len(keys) and found.count() == len(keys)
    for i, key in enumerate(keys):
        missing = key is None or int(key[1:]) >= 100
        assert got[i]["is_fallback"] == missing and got[i]["key"] == key
        assert bytes(got[i]["data"]) == (bytes(6) if missing else want(key))


def test_numbering_sorts_no_bytes(spark, store):
    images = spark.read.parquet(store).where("key <> 'k007'")
    found = src.numbered_images(images, ["key"])
    assert all("binary" not in t for t in shuffled_types(found))
    rows = found.orderBy("key").collect()
    assert [r["image_key"] for r in rows] == [f"movie_{i:05d}.jpg" for i in range(99)]
    assert all(bytes(r["data"]) == want(r["key"]) for r in rows)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_missing_images_are_stored_without_a_shuffle_of_bytes(spark, store, monkeypatch, few):
    monkeypatch.setattr(src, "MAX_BROADCAST_KEYS", few)
    images = spark.read.parquet(store)
    target = shared_dir(spark, "target")
    images.where("key < 'k005'").write.parquet(target)
    seen = []
    monkeypatch.setattr(src, "fetch", lambda *a: seen.append(lf.fetch(*a)) or seen[-1])
    rows = src.materialize_missing(images, target, "key", "data").collect()
    assert all("binary" not in t for t in shuffled_types(seen[0]))
    assert sorted(r["key"] for r in rows) == [f"k{i:03d}" for i in range(100)]
    assert all(bytes(r["data"]) in (want(r["key"]), b"b7" * 3) for r in rows)
    assert src.materialize_missing(images, target, "key", "data").count() == 100


def test_plain_scans(spark, store):
    images = spark.read.parquet(store)
    assert lf.is_plain_scan(images) and lf.is_plain_scan(images.select("key"))
    for other in (images.where("key > 'a'"), images.union(images), images.select(F.upper("key").alias("key")), images.limit(5)):
        assert not lf.is_plain_scan(other)
        placed = lf.with_places(other)
        assert placed.select(lf.FILE, lf.ROW).distinct().count() == other.count()
    assert BinaryType() == images.schema["data"].dataType


def test_align_keeps_rows_single(spark):
    made = [("f1/x.png", "x.png", 3, 1.0), ("f0/x.png", "x.png", 2, 2.0), ("f0/y.png", "y.png", None, None)]
    quality = spark.createDataFrame(made, "path STRING, file_name STRING, width INT, sharpness DOUBLE")
    rows = spark.createDataFrame([(1, "x.png"), (2, "x.png"), (3, "y.png")], "id INT, key STRING")
    assert sorted(map(tuple, im.metadata_align(rows, quality, "key").select("id", "width").collect())) == [(1, 2), (2, 2)]
    paths = spark.createDataFrame([(1, "f1/x.png"), (2, "f0/y.png")], "id INT, key STRING")
    assert [tuple(r) for r in im.metadata_align(paths, quality, "key", by_path=True).select("id", "width").collect()] == [(1, 3)]


def test_a_row_group_is_read_in_runs(tmp_path):
    """A group of 64 MB is held a few MB at a time, and a popular row is copied in pieces."""
    pq.write_table(pa.table({"data": [bytes([i % 251]) * 10_000 + str(i).encode() for i in range(6_400)]}), tmp_path / "a.parquet", row_group_size=10_000)
    files, path = lf._Files(["data"]), f"file://{tmp_path}/a.parquet"
    before, most = pa.total_allocated_bytes(), 0
    for numbers in (np.arange(0, 5_000), np.arange(5_000, 6_400, 7), np.array([3, 3, 6_399])):
        got = []
        for a, b, found in files.rows(path, numbers):
            most = max(most, pa.total_allocated_bytes() - before)
            got += [int(x[10_000:]) for x in found.column(0).to_pylist()]
            assert len(found) == b - a
            del found
        assert got == numbers.tolist()
    assert most < 32 << 20
    pieces = [len(found) for _, _, found in files.rows(path, np.zeros(10_000, np.int64))]
    assert sum(pieces) == 10_000 and max(pieces) * 10_000 <= lf.BATCH_BYTES
    assert [(a, b) for a, b, _ in lf._Files([]).rows(path, np.array([0, 6_399]))]

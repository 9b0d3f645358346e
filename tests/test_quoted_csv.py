"""One file with line breaks in quotes, read by many tasks, against the rows that were written."""

from __future__ import annotations

import random

import pytest

from loomset.sources import quoted_csv
from loomset.sources.metadata import METADATA_SCHEMA, read_metadata_csv


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def values(seed, n):
    rng = random.Random(seed)

    def value():
        kind = rng.random()
        if kind < 0.1:
            return None
        if kind < 0.2:
            return "a line\n" * rng.randrange(1, 400)  # longer than a split
        return "x" + "".join(rng.choice('ab ,"\n\n\r\té漢') for _ in range(rng.randrange(60))) + "y"

    return [(value(), value(), value()) for _ in range(n)]


def written(path, rows, end):
    quote = lambda x: "" if x is None else '"' + x.replace('"', '""') + '"'
    head = 'plot,"image\n""path""",genres' + end
    path.write_bytes((head + "".join(",".join(map(quote, r)) + end for r in rows)).encode())


def sort(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_splits(spark, small_splits, tmp_path, end):
    rows = values(1, 200)
    written(tmp_path / "one.csv", rows, end)
    path = str(tmp_path / "one.csv")
    lines = quoted_csv.file_lines(spark, path)
    assert lines.rdd.getNumPartitions() > 20 and quoted_csv.open_splits(lines).count() > 5
    assert sort(quoted_csv.read_quoted_csv(spark, path, METADATA_SCHEMA).collect()) == sort(rows)
    if end == "\n":
        options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
        alone = spark.read.schema(METADATA_SCHEMA).options(**options).csv(path)
        assert sort(alone.collect()) == sort(rows)


def test_many_files_and_the_path_without_broadcast(spark, small_splits, tmp_path, monkeypatch):
    first, second = values(2, 120), values(3, 120)
    written(tmp_path / "a.csv", first, "\n")
    written(tmp_path / "b.csv", second, "\r\n")
    (tmp_path / "c.csv").write_text("plot,image_path,genres\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text('p,i,g\n\n1,2,3\n\n"open, to the end\nof the file')
    read = lambda: sort(quoted_csv.read_quoted_csv(spark, str(tmp_path), METADATA_SCHEMA).collect())
    want = sort([*first, *second, ("1", "2", "3")])
    got = read()
    assert [r for r in got if "open, to the end" not in str(r[0])] == want and len(got) == len(want) + 1
    monkeypatch.setattr(quoted_csv, "MAX_OPEN_SPLITS", 0)
    assert read() == got


def test_without_header_and_with_types(spark, tmp_path):
    (tmp_path / "n.csv").write_text('1,"a\nb"\n2,NA\n')
    found = quoted_csv.read_quoted_csv(spark, str(tmp_path / "n.csv"), "k INT, v STRING", header=False)
    assert sort(found.collect()) == [(1, "a\nb"), (2, "NA")]


def test_metadata_reader_uses_it(spark, small_splits, tmp_path):
    rows = [(f"plot {i}\nsecond", f"p{i}", "NA" if i % 2 else "x|y") for i in range(300)]
    written(tmp_path / "m.csv", rows, "\n")
    found = read_metadata_csv(spark, str(tmp_path / "m.csv"))
    assert found.rdd.getNumPartitions() > 3
    assert sort(found.collect()) == sort((p, i, None if g == "NA" else g) for p, i, g in rows)

"""Scratch tables and their end."""

from __future__ import annotations

import os

from loomset.sources import storage


def test_stored_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(storage, "_named", {})
    first = storage.stored(spark.range(5), "five")
    second = storage.stored(spark.range(7), "seven")
    folders = [os.path.dirname(df.inputFiles()[0].removeprefix("file://")) for df in (first, second)]
    assert first.count() + second.count() == 12 and all(map(os.path.isdir, folders))
    storage.shared_dir(spark, "never-written")
    assert storage.drop_stored(spark) == 2 and not any(map(os.path.exists, folders))
    assert storage.drop_stored(spark) == 0
    assert storage.stored(spark.range(3), "three").count() == 3

"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from registry.fixtures import SCHEMAS

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in SCHEMAS:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def arranged(rows):
    return sorted((tuple(normal(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = arranged([[r[c] for c in columns] for r in df.collect()])
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        assert got == arranged([[r[i] for i in places] for r in result.fetchall()])


def test_schemas_match_the_files(spark):
    for name, ddl in SCHEMAS.items():
        stored = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        given = spark.read.schema(ddl).parquet(f"{SF_DIR}/{name}.parquet")
        assert stored.dtypes == given.dtypes


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["lang", "term", "score", "rank"] and df.count() > 0

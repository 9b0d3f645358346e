"""Table scans with an explicit schema and a chosen column list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    columns: Sequence[str] | None = None,
    split: str | None = None,
) -> DataFrame:
    """Read a Parquet table; with a schema given, no file footer is inspected.

    ``split`` picks a value of a ``split`` partition column, so the other splits are
    pruned before any file is opened.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(path)
    if split is not None:
        table = table.where(F.col("split") == split).drop("split")
    return table.select(*columns) if columns else table


def record_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet sink, also used for vocabularies."""
    df.write.mode(mode).parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metrics records as JSON lines."""
    metrics.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)

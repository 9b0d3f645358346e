"""The ``(plot, image_path, genres)`` metadata table as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.parsing import missing_to_null
from loomset.sources.quoted_csv import read_quoted_csv

METADATA_SCHEMA = "plot STRING, image_path STRING, genres STRING"


def write_metadata_csv(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Header, quotes doubled, white space kept. Files are kept small for readers that cannot split them."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def read_metadata_csv(
    spark: SparkSession, path: str, schema: str = METADATA_SCHEMA, normalise_missing: bool = True
) -> DataFrame:
    """Read it back; texts such as ``NA`` or ``None`` become null.

    A file may have any size: it is read in splits, also where quoted fields hold line breaks.
    """
    df = read_quoted_csv(spark, path, schema)
    if not normalise_missing:
        return df
    texts = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({name: missing_to_null(F.col(name)) for name in texts})

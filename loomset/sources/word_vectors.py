"""Word-vector text files: one ``word v1 ... vd`` line per word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.parsing import strip
from loomset.functions.text import SPACE_RUN


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector ARRAY<FLOAT>)``; a repeated word keeps its last line.

    The line order is (file, block start, row within the block): rows of a block
    are read in order by one task, where the row number only grows.
    """
    lines = spark.read.text(path).select(
        F.split(strip(F.col("value")), SPACE_RUN).alias("parts"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line"),
    )
    parsed = lines.where(F.get("parts", F.lit(0)) != "").select(
        F.get("parts", F.lit(0)).alias("word"),
        F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))).cast("array<float>").alias("vector"),
        "line",
    )
    return parsed.groupBy("word").agg(F.max_by("vector", "line").alias("vector"))


def write_word_vectors(df: DataFrame, path: str) -> None:
    """The matching writer for a ``(word, vector)`` table."""
    df.select(F.concat_ws(" ", F.col("word"), F.col("vector").cast("array<string>")).alias("value")).write.text(path)

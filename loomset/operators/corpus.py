"""Corpus statistics over token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.functions.text import bigrams


def top_per_group(df: DataFrame, group: str, order_by: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group.

    ``row_number() <= k`` lets Spark cut each task's rows to ``k`` per group before
    the shuffle, so a group that holds most rows sends no more than any other.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order_by))
    return df.withColumn(rank, place).where(F.col(rank) <= k)


def vocabulary_richness(df: DataFrame, category: str, tokens: str, approximate: bool = False) -> DataFrame:
    """Distinct tokens per category, most first; a category without tokens counts 0.

    The exact count groups by (category, token) first, so a large category is spread
    over the cluster. ``approximate`` uses a mergeable sketch instead.
    """
    exploded = df.select(category, F.explode_outer(tokens).alias("token"))
    count = F.approx_count_distinct("token") if approximate else F.count_distinct("token")
    return (
        exploded.groupBy(category)
        .agg(count.alias("unique_words"))
        .orderBy(F.desc("unique_words"), category)
    )


def top_bigrams(df: DataFrame, category: str, tokens: str, k: int = 5) -> DataFrame:
    """Most frequent adjacent pairs per category; ties go to the smaller pair."""
    counts = (
        df.select(category, F.explode(bigrams(F.col(tokens))).alias("bigram"))
        .groupBy(category, "bigram")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counts, category, [F.desc("n"), F.asc("bigram")], k).orderBy(category, "rank")

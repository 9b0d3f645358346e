"""Similarity of many classes with sparse vectors, through inverted lists cut into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of one term in a block; a pair of blocks is one join key.
BLOCK = 1024


def sparse_class_similarity(weights: DataFrame, label: str, term: str, weight: str, block: int = BLOCK) -> DataFrame:
    """``(a, b, similarity)``: the cosine of all class pairs that share a term, both ways, and of each class with itself.

    ``weights`` has one row for a class and a term. Pairs without a common term have cosine 0 and no row, so the
    work follows the inverted lists and not the square of the classes. The list of a term that many classes
    share is cut into blocks, and each pair of its blocks is a join key of its own. Null and zero weights are
    absent, a class without others has no row.
    """
    rows = weights.select(F.col(label).alias("c"), F.col(term).alias("t"), F.col(weight).cast("double").alias("w")).where("w <> 0")
    norms = rows.groupBy("c").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    lists = rows.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    unit = rows.join(norms, "c").select("c", "t", (F.col("w") / F.col("norm")).alias("u")).join(lists, "t")
    unit = unit.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    left = unit.select("t", F.col("own").alias("i"), every.alias("j"), F.col("c").alias("a"), F.col("u").alias("x"))
    right = unit.select("t", every.alias("i"), F.col("own").alias("j"), F.col("c").alias("b"), F.col("u").alias("y"))
    pairs = left.join(right, ["t", "i", "j"]).where("a <= b")
    upper = pairs.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return upper.select(F.explode(F.array_distinct(both)).alias("p"), "similarity").select("p.a", "p.b", "similarity")

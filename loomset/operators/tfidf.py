"""TF-IDF weights, class means and their similarity.

``fit_tfidf`` needs one shuffle, on terms, with counts combined on the map side.
Everything after it runs in place on each document: a fixed-vocabulary count vector,
the idf weights and the length normalisation are Spark ML transformers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators.corpus import top_per_group


@dataclass(frozen=True)
class TfidfModel:
    """Chosen terms in alphabetical order and their idf."""

    terms: list[str]
    idf: list[float]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """``(term_id, term, idf)``: never more rows than ``max_features``."""
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "term_id INT, term STRING, idf DOUBLE")

    def transform(self, df: DataFrame, tokens: str, output: str = "tfidf") -> DataFrame:
        """Add the length-normalised weight vector of each document; without terms it is empty."""
        if not self.terms:
            return df.withColumn(output, array_to_vector(F.array().cast("array<double>")))
        counts = CountVectorizerModel.from_vocabulary(self.terms, inputCol=tokens, outputCol="_tf")
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_w")
        scale = Normalizer(p=2.0, inputCol="_w", outputCol=output)
        return scale.transform(weigh.transform(counts.transform(df))).drop("_tf", "_w")


def fit_tfidf(df: DataFrame, tokens: str, max_features: int = 5000) -> TfidfModel:
    """Keep the terms with the highest total count and weigh them.

    ``idf = ln((1 + n) / (1 + df)) + 1`` over all ``n`` documents, empty ones too.
    Ties at the cut go to the smaller term. At most ``max_features`` rows are
    brought to the driver. A table without terms gives a model without terms.
    """
    occurrences = F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    documents = F.transform(
        F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    )
    top = (
        df.select(F.inline(F.concat(occurrences, documents)))
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .orderBy(F.desc("tf"), F.asc("term"))
        .limit(max_features)
    )
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    rows = sorted((r["term"], r["idf"]) for r in top.select("term", idf.alias("idf")).collect())
    return TfidfModel([t for t, _ in rows], [w for _, w in rows])


def _entries(vector: str):
    """Non-zero ``(term_id, weight)`` pairs of a sparse vector column."""
    sparse = F.unwrap_udt(vector)
    return F.inline(F.arrays_zip(sparse["indices"].alias("term_id"), sparse["values"].alias("weight")))


def tfidf_weights(df: DataFrame, model: TfidfModel, id_col: str, tokens: str) -> DataFrame:
    """Long format ``(id, term, weight)`` without zero weights."""
    weighted = model.transform(df.select(id_col, tokens), tokens)
    long = weighted.select(id_col, _entries("tfidf"))
    words = F.broadcast(model.vocabulary(df.sparkSession).select("term_id", "term"))  # <= max_features rows
    return long.join(words, "term_id").select(id_col, "term", "weight")


def class_mean_vectors(df: DataFrame, model: TfidfModel, category: str, tokens: str) -> DataFrame:
    """``(category, vector ARRAY<DOUBLE>)``: the mean over all documents of the class.

    Sums are built inside each task, so one class holding most documents costs
    one partial vector per task like any other.
    """
    if not model.terms:
        return df.select(category).distinct().withColumn("vector", F.array().cast("array<double>"))
    weighted = model.transform(df.select(category, tokens), tokens)
    return weighted.groupBy(category).agg(vector_to_array(Summarizer.mean(F.col("tfidf"))).alias("vector"))


def class_mean_weights(means: DataFrame, model: TfidfModel, category: str) -> DataFrame:
    """Long format ``(category, term, mean_weight)`` without zeros."""
    long = means.select(category, F.posexplode("vector").alias("term_id", "mean_weight")).where("mean_weight > 0")
    words = F.broadcast(model.vocabulary(means.sparkSession).select("term_id", "term"))  # <= max_features rows
    return long.join(words, "term_id").select(category, "term", "mean_weight")


def top_terms(mean_weights: DataFrame, category: str, k: int = 5) -> DataFrame:
    """Terms with the highest mean weight per category.

    Ranked on six decimals, then by term, so that the summation order of almost
    equal weights does not decide.
    """
    scored = mean_weights.select(category, "term", F.round("mean_weight", 6).alias("score"))
    return top_per_group(scored, category, [F.desc("score"), F.asc("term")], k).orderBy(category, "rank")

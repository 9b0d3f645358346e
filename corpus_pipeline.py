"""From raw documents to packed token sequences: four stages, each written and read again.

All stages take documents with any further columns, of whatever names, and all but the last keep the
columns. Null and empty texts fail the quality rules, so later stages see none from here; given some, the
classifier scores them, near duplicates keep them, and packing gives each its end id. Rows that repeat others
are judged alike; near duplicates keep one of those that share id and text, and rows without an id. An
empty table stays empty in every stage. Without labels the classifier rejects nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomset.llm import near_dedup, packing, quality_rules, rule_ensemble
from loomset.sources.storage import stored

#: No SQL learns a score, samples shingles or encodes; the tests compare with plain Python.
ORACLE_SQL = None


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that stand in too many texts."""
    return quality_rules.clean(docs, fold=True)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, does not reject."""
    model = rule_ensemble.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.withColumn("loomset_score", model.score(rule_ensemble.statistics(docs["text"])))
    return scored.filter(scored["loomset_score"] >= rule_ensemble.THRESHOLD).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact token counts from a histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.byte_encoding import encoder

#: Lengths that share a block of the suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """(n_tokens) of every document; a null text is an empty one and has none."""
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(ranks.value).count
        for batch in batches:
            lengths = [count(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(lengths, pa.int64())})

    return docs.select(text).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_tokens, docs): how many documents have each length; combined in each task."""
    return lengths.groupBy(*(by or []), "n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: documents and tokens of that length or more, and what a limit there keeps.

    ``truncated_tokens`` is the total when every document is cut to ``n_tokens``, and
    ``share_at_most`` the share of documents that fit. Sums within a block of lengths are
    added to those of all later blocks, so no task sees more than a block or one row a
    block. An empty histogram gives an empty table.
    """
    rows = histogram.select("n_tokens", "docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    own = [F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t")]
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = rows.groupBy("block").agg(*own)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, "block")
    docs = F.sum("docs").over(within) + F.col("docs_after")
    tokens = F.sum(F.col("docs") * F.col("n_tokens")).over(within) + F.col("tokens_after")
    summed = joined.select("*", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"))
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    fits = F.col("all_docs") - F.col("docs_at_least") + F.col("docs")
    return summed.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least", kept.alias("truncated_tokens"),
        (fits / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens) for any limits, from one pass over the histogram."""
    table = histogram.select("n_tokens", "docs", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit"))
    over = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("docs")).otherwise(0)
    kept = F.col("docs") * F.least("n_tokens", "context_limit")
    return table.groupBy("context_limit").agg(F.sum(over).alias("docs_over"), F.sum(kept).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of the documents does not exceed."""
    table = sums.select("n_tokens", "share_at_most", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return table.filter(F.col("share_at_most") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))

"""Scan and round-trip queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.functions import parsing as ps
from loomset.sources import metadata as md
from loomset.sources import tables as tb
from loomset.sources.storage import shared_dir
from loomset.sources.word_vectors import read_word_vectors, write_word_vectors
from registry import query
from registry.evaluation import compared
from registry.fixtures import SCHEMAS, r6, records, saved_vocab, table
from registry.sql import COMPARISON, RECORDS, SCORES4, VOCAB


@query("scan_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_table(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "record_count",
    " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in SCHEMAS),
)
def record_count(spark, sf_dir):
    counts = None
    for name in SCHEMAS:
        one = tb.record_count(table(spark, sf_dir, name)).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def metadata(spark, sf_dir):
    """``(plot, image_path, genres)``; assistant rows have the label text ``NA``, system rows none."""
    rows = records(spark, sf_dir)
    genres = ps.pipe_join(ps.genres_trim(ps.message(F.col("messages"), 1)))
    marked = F.when(F.col("role") == "assistant", F.lit("NA")).otherwise(genres)
    return rows.select(
        ps.plot_last(ps.message(F.col("messages"), 0)).alias("plot"),
        F.concat(F.lit("data/images/"), "msg_id", F.lit(".jpg")).alias("image_path"),
        marked.alias("genres"),
    )


METADATA = rf"""{RECORDS},
metadata AS (
  SELECT list_last(string_split(content, 'Plot: ')) AS plot, 'data/images/' || msg_id || '.jpg' AS image_path,
    CASE WHEN role = 'assistant' THEN 'NA' ELSE
      array_to_string(list_transform(string_split(answer, ','), lambda g: regexp_replace(g, '^\s+|\s+$', '', 'g')), '|')
    END AS genres FROM records)"""


def _written(spark, sf_dir):
    path = shared_dir(spark, "metadata")
    md.write_metadata_csv(metadata(spark, sf_dir), path)
    return path


@query("metadata_csv_write", f"WITH {METADATA} SELECT plot, image_path, genres FROM metadata")
def metadata_csv_write(spark, sf_dir):
    return md.read_metadata_csv(spark, _written(spark, sf_dir), normalise_missing=False)


@query("metadata_csv_read", f"WITH {METADATA} SELECT plot, image_path, nullif(genres, 'NA') AS genres FROM metadata")
def metadata_csv_read(spark, sf_dir):
    return md.read_metadata_csv(spark, _written(spark, sf_dir))


@query(
    "word_vectors_read",
    """SELECT 'v' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS dim,
      round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total
    FROM embeddings""",
)
def word_vectors_read(spark, sf_dir):
    path = shared_dir(spark, "word-vectors")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").alias("vector")
    )
    write_word_vectors(vectors, path)
    values = F.col("vector").cast("array<double>")
    return read_word_vectors(spark, path).select(
        "word",
        F.size("vector").alias("dim"),
        r6(F.get(values, F.lit(0))).alias("first"),
        r6(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
    )


@query("vocab_write", f"WITH {VOCAB} SELECT token, CAST(id AS BIGINT) AS id FROM vocab")
def vocab_write(spark, sf_dir):
    path = shared_dir(spark, "vocab-table")
    tb.write_table(saved_vocab(spark, sf_dir).select("token", "id"), path)
    return tb.scan_table(spark, path, "token STRING, id BIGINT")


@query(
    "metrics_write",
    f"WITH {COMPARISON} "
    + " UNION ALL ".join(f"SELECT mode, '{s}' AS metric, round({s}, 6) AS value FROM comparison" for s in SCORES4),
)
def metrics_write(spark, sf_dir):
    path = shared_dir(spark, "metrics")
    long = compared(spark, sf_dir).unpivot("mode", SCORES4, "metric", "value")
    tb.write_metrics(long, path)
    stored = tb.read_metrics(spark, path, "mode STRING, metric STRING, value DOUBLE")
    return stored.withColumn("value", r6("value"))

"""Parsing and multi-label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.functions import parsing as ps
from loomset.functions.vectors import sigmoid, threshold_all
from loomset.operators import label_bitmaps as bm
from loomset.operators import labels as lb
from loomset.operators.stats import decode
from loomset.sources.tables import drop_nulls
from registry import query
from registry.fixtures import CLASS_NAMES, label_predictions, label_table, r6, records, saved_labels, table
from registry.sql import CELLS, MEMBERS, RECORDS


@query(
    "label_decode",
    "SELECT vec_id, label, CASE label "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in CLASS_NAMES.items())
    + " END AS class_name FROM embeddings",
)
def label_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", decode(F.col("label"), CLASS_NAMES).alias("class_name"))


@query(
    "plot_parse_last",
    f"WITH {RECORDS} SELECT msg_id, list_last(string_split(content, 'Plot: ')) AS plot FROM records",
)
def plot_parse_last(spark, sf_dir):
    return records(spark, sf_dir).select("msg_id", ps.plot_last(ps.message(F.col("messages"), 0)).alias("plot"))


@query(
    "plot_parse_strict",
    f"WITH {RECORDS} SELECT msg_id, plot, array_to_string(string_split(answer, ', '), '|') AS genres FROM strict",
)
def plot_parse_strict(spark, sf_dir):
    parsed = records(spark, sf_dir).select("msg_id", ps.parse_strict(F.col("messages")).alias("p"))
    return parsed.select("msg_id", "p.plot", F.array_join("p.genres", "|").alias("genres"))


@query(
    "genres_parse_trim",
    rf"""WITH {RECORDS},
    pieces AS (SELECT msg_id, list_transform(string_split(answer, ','),
               lambda g: regexp_replace(g, '^\s+|\s+$', '', 'g')) AS g FROM records)
    SELECT msg_id, CAST(len(g) AS INTEGER) AS n, array_to_string(g, '|') AS genres FROM pieces""",
)
def genres_parse_trim(spark, sf_dir):
    genres = ps.genres_trim(ps.message(F.col("messages"), 1))
    rows = records(spark, sf_dir).select("msg_id", genres.alias("g"))
    return rows.select("msg_id", F.size("g").alias("n"), F.array_join("g", "|").alias("genres"))


@query(
    "genres_parse_raw",
    f"""WITH {RECORDS}, pieces AS (SELECT msg_id, string_split(answer, ', ') AS g FROM records)
    SELECT msg_id, CAST(len(g) AS INTEGER) AS n, array_to_string(g, '|') AS genres FROM pieces""",
)
def genres_parse_raw(spark, sf_dir):
    rows = records(spark, sf_dir).select("msg_id", ps.genres_raw(ps.message(F.col("messages"), 1)).alias("g"))
    return rows.select("msg_id", F.size("g").alias("n"), F.array_join("g", "|").alias("genres"))


@query(
    "genres_pipe_join",
    f"""WITH {MEMBERS}
    SELECT o.o_orderkey, coalesce(string_agg(brand, '|' ORDER BY brand), '') AS genres
    FROM orders o LEFT JOIN member m ON m.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
)
def genres_pipe_join(spark, sf_dir):
    return label_table(spark, sf_dir).select("o_orderkey", ps.pipe_join(F.col("genres")).alias("genres"))


@query(
    "genres_pipe_split",
    f"""WITH {MEMBERS}
    SELECT o.o_orderkey, CAST(count(brand) AS INTEGER) AS n,
           coalesce(string_agg(brand, ',' ORDER BY brand), '') AS genres
    FROM orders o LEFT JOIN member m ON m.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
)
def genres_pipe_split(spark, sf_dir):
    joined = label_table(spark, sf_dir).select("o_orderkey", ps.pipe_join(F.col("genres")).alias("text"))
    stored = joined.withColumn("text", F.nullif("text", F.lit("")))
    rows = stored.select("o_orderkey", ps.pipe_split(F.col("text")).alias("g"))
    return rows.select("o_orderkey", F.size("g").alias("n"), F.array_join("g", ",").alias("genres"))


@query(
    "reject_rows",
    f"""WITH {RECORDS}
    SELECT msg_id, CASE WHEN strpos(content, 'Plot: ') = 0 THEN 'no plot marker'
                        WHEN answer IS NULL THEN 'no labels' END AS reason FROM records""",
)
def reject_rows(spark, sf_dir):
    rows = records(spark, sf_dir)
    checks = {
        "no plot marker": ps.plot_strict(ps.message(F.col("messages"), 0)).isNotNull(),
        "no labels": ps.message(F.col("messages"), 1).isNotNull(),
    }
    good, bad = lb.split_rejects(rows, "msg_id", checks)
    return good.select("msg_id", F.lit(None).cast("string").alias("reason")).unionByName(bad)


@query(
    "drop_nulls",
    f"WITH {RECORDS} SELECT msg_id, plot, answer FROM strict WHERE plot IS NOT NULL AND answer IS NOT NULL",
)
def drop_nulls_query(spark, sf_dir):
    parsed = records(spark, sf_dir).select("msg_id", ps.parse_strict(F.col("messages")).alias("p"))
    rows = parsed.select("msg_id", "p.plot", F.array_join("p.genres", ", ").alias("answer"))
    return drop_nulls(rows, ["plot", "answer"])


@query("label_counts", f"WITH {MEMBERS} SELECT brand AS label, count(*) AS n FROM member GROUP BY brand")
def label_counts(spark, sf_dir):
    return lb.label_counts(label_table(spark, sf_dir), "genres")


@query(
    "label_cardinality_distribution",
    f"""WITH {MEMBERS}, sizes AS (
      SELECT o.o_orderkey, CAST(count(brand) AS INTEGER) AS num_labels
      FROM orders o LEFT JOIN member m ON m.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey)
    SELECT num_labels, count(*) AS n FROM sizes GROUP BY num_labels""",
)
def label_cardinality_distribution(spark, sf_dir):
    return lb.label_cardinality_distribution(label_table(spark, sf_dir), "genres")


@query(
    "label_summary",
    f"""WITH {MEMBERS}
    SELECT (SELECT count(*) FROM orders) AS n_rows, count(DISTINCT brand) AS n_labels,
           round(count(*) / (SELECT count(*) FROM orders), 6) AS mean_labels FROM member""",
)
def label_summary(spark, sf_dir):
    return lb.label_summary(saved_labels(spark, sf_dir), "genres").withColumn("mean_labels", r6("mean_labels"))


@query(
    "multi_hot",
    f"""WITH {CELLS}
    SELECT o_orderkey, string_agg(CAST(t AS VARCHAR), '' ORDER BY pos) AS labels_binary
    FROM cells GROUP BY o_orderkey""",
)
def multi_hot(spark, sf_dir):
    rows = saved_labels(spark, sf_dir)
    hot = lb.multi_hot(rows, "genres", lb.fit_classes(rows, "genres"))
    return hot.select("o_orderkey", F.array_join(F.col("labels_binary").cast("array<string>"), "").alias("labels_binary"))


COOCCURRENCE = f"""WITH {MEMBERS}
    SELECT x.brand AS a, y.brand AS b, count(*) AS n_ab
    FROM member x JOIN member y ON x.o_orderkey = y.o_orderkey GROUP BY x.brand, y.brand"""


@query("label_cooccurrence", COOCCURRENCE)
def label_cooccurrence(spark, sf_dir):
    return lb.label_cooccurrence(label_table(spark, sf_dir), "genres")


@query("label_cooccurrence_bitmaps", COOCCURRENCE)
def label_cooccurrence_bitmaps(spark, sf_dir):
    """The same rows by intersections of bitmaps, for rows of many labels."""
    return bm.cooccurrence_by_bitmaps(label_table(spark, sf_dir), "genres")


@query(
    "label_correlation",
    f"""WITH {CELLS}
    SELECT x.brand AS a, y.brand AS b, round(corr(x.t, y.t), 6) + 0.0 AS correlation
    FROM cells x JOIN cells y ON x.o_orderkey = y.o_orderkey GROUP BY x.brand, y.brand""",
)
def label_correlation(spark, sf_dir):
    return lb.label_correlation(saved_labels(spark, sf_dir), "genres").withColumn("correlation", r6("correlation"))


@query(
    "threshold_labels",
    f"""WITH {CELLS}
    SELECT o_orderkey,
      string_agg(CASE WHEN 1 / (1 + exp(-logit)) > 0.5 THEN '1' ELSE '0' END, '' ORDER BY pos) AS at_50,
      string_agg(CASE WHEN 1 / (1 + exp(-logit)) > 0.3 THEN '1' ELSE '0' END, '' ORDER BY pos) AS at_30,
      string_agg(CASE WHEN 1 / (1 + exp(-logit)) > 0.1 THEN '1' ELSE '0' END, '' ORDER BY pos) AS at_10
    FROM cells GROUP BY o_orderkey""",
)
def threshold_labels(spark, sf_dir):
    predictions, _ = label_predictions(spark, sf_dir)
    probabilities = predictions.select("o_orderkey", F.transform("logits", sigmoid).alias("p"))
    cuts = [
        F.array_join(threshold_all(F.col("p"), c / 100).cast("array<string>"), "").alias(f"at_{c}") for c in (50, 30, 10)
    ]
    return probabilities.select("o_orderkey", *cuts)

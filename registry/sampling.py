"""Split, sample and batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.operators import batches as bt
from loomset.operators import splits as sp
from loomset.operators import vocab as vc
from registry import query
from registry.fixtures import documents, saved_vocab, table
from registry.sql import PUNCT_PATTERN, VOCAB_512, hash_order

ORDERED = f"""ranked AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY {hash_order('o_orderkey')}) AS r,
         count(*) OVER () AS n FROM orders),
sized AS (SELECT o_orderkey, r, n, n - ceil(0.2 * n) AS train, ceil(0.2 * n) AS held FROM ranked)"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey")


@query(
    "split_80_10_10",
    f"""WITH {ORDERED}
    SELECT o_orderkey, CASE WHEN r <= train THEN 'train' WHEN r <= n - ceil(0.5 * held) THEN 'val' ELSE 'test' END AS split
    FROM sized""",
)
def split_80_10_10(spark, sf_dir):
    return sp.split_train_val_test(_orders(spark, sf_dir), "o_orderkey")


@query(
    "split_90_10",
    f"""SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY {hash_order('vec_id')}) <= floor(0.9 * count(*) OVER ())
    THEN 'train' ELSE 'val' END AS split FROM embeddings""",
)
def split_90_10(spark, sf_dir):
    return sp.split_train_val(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


@query("split_80_20", f"WITH {ORDERED} SELECT o_orderkey, CASE WHEN r <= train THEN 'train' ELSE 'val' END AS split FROM sized")
def split_80_20(spark, sf_dir):
    return sp.split_held_out(_orders(spark, sf_dir), "o_orderkey")


@query(
    "few_shot_sample",
    f"WITH {ORDERED} SELECT o_orderkey FROM sized WHERE r <= round_even(0.05 * train, 0)",
)
def few_shot_sample(spark, sf_dir):
    return sp.few_shot_sample(_orders(spark, sf_dir), "o_orderkey")


@query(
    "fixed_size_sample",
    f"""SELECT o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (ORDER BY {hash_order('o_orderkey')}) <= 500""",
)
def fixed_size_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sp.fixed_size_sample(rows, "o_orderkey", 500)


STRATIFIED_ROWS = 60


@query(
    "stratified_sample",
    f"""WITH rows AS (SELECT d.doc_id, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    share AS (SELECT quality, count(*) AS n, count(*) * {STRATIFIED_ROWS}.0 / (SELECT count(*) FROM rows) AS exact
              FROM rows GROUP BY quality),
    ordered AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, quality) AS k FROM share),
    quota AS (SELECT quality, least(n, base + CASE WHEN k <= {STRATIFIED_ROWS} - sum(base) OVER () THEN 1 ELSE 0 END) AS q
              FROM ordered)
    SELECT doc_id, rows.quality FROM rows JOIN quota ON quota.quality = rows.quality
    QUALIFY row_number() OVER (PARTITION BY rows.quality ORDER BY {hash_order('doc_id')}) <= q""",
)
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    )
    return sp.stratified_sample(rows, "doc_id", "quality", STRATIFIED_ROWS)


@query(
    "shuffle_batches",
    f"""SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {hash_order('o_orderkey')}) - 1) // 32 AS BIGINT) AS batch_id
    FROM orders""",
)
def shuffle_batches(spark, sf_dir):
    return sp.shuffle_batches(_orders(spark, sf_dir), "o_orderkey", 32)


@query(
    "collate_batches",
    f"""WITH {VOCAB_512},
    firsts100 AS (SELECT doc_id, list_slice(regexp_extract_all(lower(left(text, 512)), '{PUNCT_PATTERN}'), 1, 100) AS t FROM documents),
    coded AS (SELECT doc_id, sum(coalesce(v.id, 1)) AS id_sum
              FROM (SELECT doc_id, unnest(t) AS token FROM firsts100) LEFT JOIN vocab v USING (token) GROUP BY doc_id),
    dealt AS (SELECT doc_id, len(t) AS n, CAST((row_number() OVER (ORDER BY {hash_order('doc_id')}) - 1) // 32 AS BIGINT) AS batch_id
              FROM firsts100)
    SELECT batch_id, count(*) AS n_rows, CAST(max(n) AS BIGINT) AS width, CAST(sum(max_n - n) AS BIGINT) AS n_padding,
      CAST(coalesce(sum(id_sum), 0) AS BIGINT) AS id_sum, CAST(sum(n) AS BIGINT) AS n_real, min(doc_id) AS first_id
    FROM (SELECT *, max(n) OVER (PARTITION BY batch_id) AS max_n FROM dealt) LEFT JOIN coded USING (doc_id) GROUP BY batch_id""",
)
def collate_batches(spark, sf_dir):
    """Shuffled batches of encoded documents, each as wide as its longest row."""
    docs, vocab = documents(spark, sf_dir, "doc_id", "text"), saved_vocab(spark, sf_dir, 512)
    coded = vc.encode_sequences(docs, "doc_id", "text", vocab, max_chars=512)
    rows = sp.shuffle_batches(coded.select("doc_id", F.expr("slice(input_ids, 1, n_tokens)").alias("ids")), "doc_id", 32)
    made = bt.collate_batches(rows, "batch_id", "doc_id", "ids")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select(
        "batch_id", "n_rows", "width", "n_padding", total("input_ids").alias("id_sum"),
        total("attention_mask").alias("n_real"), F.get("row_ids", F.lit(0)).alias("first_id"),
    )

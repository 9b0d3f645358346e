"""The test tables as the inputs the operators expect."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.label_names import CIFAR_10, by_id
from loomset.functions.text import clean_tokens, default_stop_words, remove_stopwords, tokenize_words_punct, word_count
from loomset.functions.vectors import argmax
from loomset.operators.dense import class_mean_vector
from loomset.operators.labels import fit_classes, multi_hot
from loomset.operators.scoring import class_scores
from loomset.operators.vocab import build_vocab
from loomset.plans.ranking import global_index
from loomset.plans.sizes import spread_small
from loomset.sources.storage import shared_dir, stored
from loomset.sources.tables import scan_table

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# The last of the ten vector classes is left out to test unknown labels.
CLASS_NAMES = by_id(CIFAR_10[:9])
LOGIT_SCALE = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def r6(column: Column | str) -> Column:
    """Six decimals without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


# --- text -------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chosen columns of the documents; a small file is spread over the cores."""
    return spread_small(table(spark, sf_dir, "documents").select(*columns))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, tokens)`` without stop words."""
    tokens = remove_stopwords(clean_tokens(F.col("text")), default_stop_words())
    return documents(spark, sf_dir, "doc_id", "lang", "text").select("doc_id", "lang", tokens.alias("tokens"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", word_count(F.col("text")).alias("word_count"))


def saved_vocab(spark: SparkSession, sf_dir: str, max_chars: int | None = None) -> DataFrame:
    """The vocabulary of the documents, built once, stored and read back."""
    return stored(build_vocab(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", max_chars), "vocab")


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, vector)``: the i-th distinct token in alphabetical order gets vector i."""
    words = (
        documents(spark, sf_dir, "text")
        .select(F.explode(F.array_distinct(tokenize_words_punct(F.col("text")))).alias("word"))
        .distinct()
    )
    ranked = global_index(words, ["word"], "vec_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ranked.join(vectors, "vec_id").select("word", "vector")


# --- chat records -----------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(msg_id, role, messages)``: a description with markers and a label string.

    System rows have no marker and no second message; second turns repeat the marker.
    """
    text, turn = F.col("text"), F.col("turn")
    head = F.when(turn == 1, "Title. Plot: intro Plot: ").otherwise("Title. Plot: ")
    content = F.when(F.col("role") == "system", text).otherwise(F.concat(head, text, F.lit("\nNote: end")))
    words = F.split(text, " ")
    first, second = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    genres = (
        F.when(turn % 3 == 0, F.concat(first, F.lit(" , "), second))
        .when(turn % 3 == 1, F.concat(first, F.lit(", "), second))
        .otherwise(first)
    )
    user = F.struct(F.lit("user").alias("role"), content.alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), genres.alias("content"))
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"),
        "role",
        F.when(F.col("role") == "system", F.array(user)).otherwise(F.array(user, answer)).alias("messages"),
    )


# --- multi-label ------------------------------------------------------------------


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, genres)``: the sorted distinct brands of every order, maybe none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    none = F.array().cast("array<string>")
    return orders.join(brands, "o_orderkey", "left").select(
        "o_orderkey", F.coalesce("brands", none).alias("genres")
    )


def saved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table as a stored input, for operators that read it more than once."""
    return stored(label_table(spark, sf_dir), "labels")


def label_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(o_orderkey, y_true, logits, y_pred)`` and the one-row class table."""
    rows = saved_labels(spark, sf_dir)
    classes = fit_classes(rows, "genres")
    hot = multi_hot(rows, "genres", classes, "y_true")

    def logit(brand: Column, t: Column) -> Column:
        b = F.substring(brand, 7, 9).cast("bigint")
        mixed = (F.col("o_orderkey") * 7919 + b * 104729) % 2001 - 1000
        return mixed / F.lit(250.0) + t * 3 - F.lit(1.5)

    named = hot.withColumn("known", classes.select("classes").scalar())
    scored = named.withColumn("logits", F.zip_with("known", "y_true", logit))
    predicted = F.transform("logits", lambda x: (x > 0).cast("int"))
    return scored.select("o_orderkey", "y_true", "logits", predicted.alias("y_pred")), classes


# --- vectors ----------------------------------------------------------------------


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modalities: the first and the last 32 dimensions."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.slice("embedding", 1, 32).alias("image"),
        F.slice("embedding", 33, 32).alias("text"),
    )


def prototypes(df: DataFrame, vector: str) -> DataFrame:
    return class_mean_vector(df, "label", vector, "w")


def prototype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, scores)`` against the class means."""
    rows = table(spark, sf_dir, "embeddings")
    return class_scores(rows, "vec_id", "embedding", prototypes(rows, "embedding"), "label", "w", LOGIT_SCALE)


def nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, y_true, y_pred)``; the labels are 0 to 9, so a position is a label."""
    return prototype_scores(spark, sf_dir).select(
        "vec_id", F.col("label").alias("y_true"), argmax(F.col("scores")).alias("y_pred")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension as an integer from 0 to 255."""
    value = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 127.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", value.alias("pixels"))


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of 64 pixels, 4, 8 or 16 wide (by label), as scanned image rows."""
    width = F.pow(F.lit(2), F.lit(2) + F.col("label") % 3)
    data = F.unhex(F.array_join(F.transform("pixels", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return (
        pixels(spark, sf_dir)
        .withColumn("width", width.cast("int"))
        .select(
            "vec_id",
            "label",
            F.format_string("img_%06d.png", F.col("vec_id")).alias("file_name"),
            F.col("vec_id").cast("string").alias("path"),
            "width",
            (F.lit(64) / F.col("width")).cast("int").alias("height"),
            F.lit(1).alias("channels"),
            F.lit("L").alias("color_mode"),
            F.lit(0.0).alias("file_size_kb"),
            data.alias("data"),
        )
    )


def png_bytes(data: bytes, width: int, height: int, color: int = 0, samples: int = 1) -> bytes:
    """An uncompressed 8-bit PNG file (color 0 gray, 2 RGB, 6 RGBA)."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    step = width * samples
    lines = b"".join(b"\x00" + data[y * step : (y + 1) * step] for y in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    body = chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines, 0)) + chunk(b"IEND", b"")
    return b"\x89PNG\r\n\x1a\n" + body


def color_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the same values: by label 8 x 8 gray, 7 x 3 RGB (one value over) or 4 x 4 RGBA."""
    kind = F.col("label") % 3
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), kind + 1)
    return gray_images(spark, sf_dir).select(
        "vec_id", "label", "file_name", pick(8, 7, 4).alias("width"), pick(8, 3, 4).alias("height"),
        pick(0, 2, 6).alias("color"), pick(1, 3, 4).alias("samples"), "data",
    )


def png_store(spark: SparkSession, sf_dir: str, images: DataFrame | None = None) -> str:
    """Write the images (the gray ones) as PNG files and return their folder.

    The files of class 8 are no images. The tasks write the files themselves; a repeated
    task writes the same bytes under the same names.
    """
    folder = shared_dir(spark, "png")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        files, root = FileSystem.from_uri(target)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.itertuples():
                body = b"not an image" if row.label == 8 else png_bytes(row.data, row.width, row.height, row.color, row.samples)
                with files.open_output_stream(f"{root}/{row.file_name}") as out:
                    out.write(body)
            yield batch[["vec_id"]]

    if images is None:
        images = gray_images(spark, sf_dir).withColumns({"color": F.lit(0), "samples": F.lit(1)})
    images = images.select("vec_id", "label", "file_name", "width", "height", "color", "samples", "data")
    images.mapInPandas(write, "vec_id BIGINT").count()
    return folder


# --- epochs -----------------------------------------------------------------------


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, epoch, score, seconds)`` from the events of each user and day.

    The score is cut to one decimal in integers, which makes ties.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("seconds"))
        .select("run", "epoch", (F.floor(F.col("cents") / (F.col("seconds") * 10)) / 10.0).alias("score"), "seconds")
    )

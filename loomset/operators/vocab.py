"""Vocabulary building, token lookup, fixed-length encoding, embedding rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import tokenize_words_punct
from loomset.plans.ranking import global_index
from loomset.sources.storage import stored

PAD, UNK = 0, 1
SPECIAL_TOKENS = [("<pad>", PAD), ("<unk>", UNK)]
MAX_LOCAL_ENTRIES = 1_000_000
#: Bytes of all tokens of a vocabulary that is broadcast, and of one token of the hot ones.
MAX_LOCAL_BYTES = 64 << 20
MAX_HOT_TOKEN_BYTES = 512


def document_tokens(text: Column, max_chars: int | None) -> Column:
    """Words and punctuation of the first ``max_chars`` characters (None: all)."""
    return tokenize_words_punct(text if max_chars is None else F.left(text, F.lit(max_chars)))


def build_vocab(df: DataFrame, id_col: str, text_col: str, max_chars: int | None = None) -> DataFrame:
    """``(token, id, n_docs)`` with ids from 2 in first-seen order.

    First seen means the smallest (document id, position). A document sends each
    token once, and the counts are combined before the shuffle, so a frequent
    token costs one row per task.
    """
    return build_token_vocab(df, id_col, document_tokens(F.col(text_col), max_chars))


def build_token_vocab(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``build_vocab`` of token arrays, for texts that are tokenised already."""
    seen = df.select(F.col(id_col).alias("doc"), F.posexplode(F.array_distinct(tokens)).alias("pos", "token"))
    first = seen.groupBy("token").agg(
        F.min("doc").alias("doc"), F.min_by("pos", "doc").alias("pos"), F.count(F.lit(1)).alias("n_docs")
    )
    numbered = global_index(first, ["doc", "pos"], "id").select(
        "token", (F.col("id") + len(SPECIAL_TOKENS)).cast("bigint").alias("id"), "n_docs"
    )
    special = df.sparkSession.createDataFrame(
        [(t, i, 0) for t, i in SPECIAL_TOKENS], "token STRING, id BIGINT, n_docs BIGINT"
    )
    return special.unionByName(numbered)


def _entries(vocab: DataFrame) -> DataFrame:
    return vocab.where(~F.col("token").isin([t for t, _ in SPECIAL_TOKENS]))


def is_local(entries: DataFrame, token: str, max_entries: int, max_bytes: int = MAX_LOCAL_BYTES) -> bool:
    """Whether a vocabulary is small enough to be sent to every worker, counted in rows and in bytes."""
    n, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(token)), F.lit(0))).first()
    return n <= max_entries and size <= max_bytes


def vocab_lookup(
    tokens: DataFrame,
    vocab: DataFrame,
    token: str = "token",
    output: str = "token_id",
    max_entries: int = MAX_LOCAL_ENTRIES,
    hot_tokens: int = 100_000,
    max_bytes: int = MAX_LOCAL_BYTES,
) -> DataFrame:
    """Add the id of every token; tokens outside the vocabulary get 1, null stays null.

    A vocabulary counted to at most ``max_entries`` rows and ``max_bytes`` is broadcast. For a larger
    one the rows are stored once and their tokens counted, those outside the vocabulary too.
    The ``hot_tokens`` most frequent tokens of ordinary length are broadcast with their ids, which answers
    most rows where they are. Only the remaining rows are shuffled, and each of their
    tokens holds less than ``1 / hot_tokens`` of all rows.
    """
    entries = _entries(vocab).select(F.col("token").alias(token), F.col("id").alias("_id"))
    unknown = F.lit(UNK).cast("bigint")
    value = F.when(F.col(token).isNotNull(), F.coalesce("_id", unknown)).alias(output)
    if is_local(entries, token, max_entries, max_bytes):
        return tokens.join(F.broadcast(entries), token, "left").select(*tokens.columns, value)
    tokens = stored(tokens, "lookup")
    counts = tokens.where(F.col(token).isNotNull()).groupBy(token).agg(F.count(F.lit(1)).alias("_n"))
    short = counts.where(F.octet_length(token) <= MAX_HOT_TOKEN_BYTES)
    hot = stored(short.orderBy(F.desc("_n"), token).limit(hot_tokens).select(token), "hot-tokens")
    hot = hot.join(entries, token, "left").select(token, F.coalesce("_id", unknown).alias("_id"))
    tried = tokens.join(F.broadcast(hot), token, "left").select(*tokens.columns, "_id")
    answered = F.col("_id").isNotNull() | F.col(token).isNull()
    rare = tried.where(~answered).drop("_id").join(entries, token, "left")
    return tried.where(answered).select(*tokens.columns, value).unionByName(rare.select(*tokens.columns, value))


def attention_mask(n_tokens: Column, length: int) -> Column:
    """Ones for the real tokens, zeros for the padding."""
    real = F.least(n_tokens, F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def _ids_in_place(vocab: DataFrame):
    """Arrow function from token arrays to id arrays, for a vocabulary of known size."""
    rows = _entries(vocab).select("token", "id").toArrow()
    known = pd.Index(rows.column("token").to_pandas(), dtype=object)
    ids = rows.column("id").to_numpy()

    @F.arrow_udf("array<bigint>")
    def encode(tokens: pa.Array) -> pa.Array:
        # The index hashes its words at the first batch of a task and keeps the table.
        places = known.get_indexer(pd.Index(tokens.flatten().to_pandas(), dtype=object))
        values = np.full(len(places), UNK, np.int64)
        values[places >= 0] = ids[places[places >= 0]]
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))

    return encode


def encode_sequences(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocab: DataFrame,
    length: int = 100,
    max_chars: int | None = None,
    keep: Sequence[str] = (),
    max_entries: int = MAX_LOCAL_ENTRIES,
) -> DataFrame:
    """``(id, *keep, n_tokens, input_ids, attention_mask)`` of exactly ``length`` entries.

    A vocabulary of at most ``max_entries`` rows and 64 MB goes to the tasks as Arrow arrays
    and every document is encoded where it is, without a shuffle. Beyond that the rows
    are stored with a number each, and their tokens exploded and joined; a row is then a
    group of at most ``length`` tokens. Rows that repeat an id stay rows of their own.
    """
    tokens = F.slice(document_tokens(F.col(text_col), max_chars), F.lit(1), F.lit(length))
    if is_local(_entries(vocab), "token", max_entries):
        coded = df.select(id_col, *keep, _ids_in_place(vocab)(tokens).alias("ids"))
    else:
        cut = stored(df.select(id_col, *keep, tokens.alias("_tokens"), F.monotonically_increasing_id().alias("_row")), "cut")
        exploded = cut.select("_row", id_col, *keep, F.posexplode_outer("_tokens").alias("pos", "token"))
        found = vocab_lookup(exploded, vocab, max_entries=max_entries)
        pairs = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id")))
        grouped = found.groupBy("_row", id_col, *keep).agg(F.array_sort(pairs).alias("pairs"))
        coded = grouped.select(id_col, *keep, F.transform("pairs", lambda p: p["token_id"]).alias("ids"))
    n = F.size("ids")
    padding = F.array_repeat(F.lit(PAD).cast("bigint"), F.lit(length) - n)
    return coded.select(
        id_col,
        *keep,
        n.alias("n_tokens"),
        F.concat("ids", padding).alias("input_ids"),
        attention_mask(n, length).alias("attention_mask"),
    )


def word_vector_lookup(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vocabulary rows with their word vector and an ``oov`` flag.

    Both sides have one row per word, so no join key repeats.
    """
    joined = vocab.join(vectors.select(F.col("word").alias("token"), "vector"), "token", "left")
    return joined.withColumn("oov", F.col("vector").isNull())


def random_normal_vector(token: Column, dim: int, seed: int) -> Column:
    """Standard-normal values that depend only on the seed, the token and the place."""

    def uniform(i: Column, stream: int) -> Column:
        draw = F.pmod(F.xxhash64(token, i, F.lit(seed), F.lit(stream)), F.lit(1 << 53))
        return (draw.cast("double") + 0.5) / float(1 << 53)

    def normal(i: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(uniform(i, 0)))
        return (radius * F.cos(2.0 * F.pi() * uniform(i, 1))).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal)


def embedding_matrix(
    vocab: DataFrame, vectors: DataFrame, dim: int = 100, seed: int = 42, zero_pad: bool = False
) -> DataFrame:
    """``(id, token, oov, vector)``: the word's vector, or a seeded random one."""
    found = word_vector_lookup(vocab.select("token", "id"), vectors)
    fallback = random_normal_vector(F.col("token"), dim, seed)
    if zero_pad:
        zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
        fallback = F.when(F.col("id") == PAD, zeros).otherwise(fallback)
    return found.select("id", "token", "oov", F.coalesce("vector", fallback).alias("vector"))


def oov_rate(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.count(F.lit(1)).alias("n_tokens"), F.avg(F.col("oov").cast("int")).alias("oov_rate"))

"""One query per operator over the whole of its test table, with its SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import (
    html_render,
    licences,
    merkle,
    near_dedup,
    oracles,
    packing,
    piece_encoding,
    quality_rules,
    revisits,
    rule_ensemble,
    sharding,
    source_divergence,
    token_lengths,
    vector_search,
)
from loomset.sources.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its own name, with the SQL of that name if there is one."""
    QUERIES[fn.__name__] = fn
    if hasattr(oracles, fn.__name__.upper()):
        ORACLES[fn.__name__] = getattr(oracles, fn.__name__.upper())
    return fn


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; a source stands for a host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    judged = quality_rules.judge(docs)
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in [*names, "removed_words"]])


@query
def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = rule_ensemble.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = rule_ensemble.classify(docs, model)
    held_out = rule_ensemble.is_held_out(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "quality.score", "quality.predicted")


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, and the links of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup.classes(docs)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
    return packed.select(*names, F.crc32("ids").alias("ids_crc32"))


@query
def op8_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums of the lengths of all documents, by encoded length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    lengths = token_lengths.encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_lengths.suffix_sums(stored(token_lengths.length_histogram(lengths), "lengths"))


@query
def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = piece_encoding.decode(piece_encoding.encode(docs, model), model)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0)


@query
def op1_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return html_render.extract(pages)


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures made of pages: a response each, and a later revisit of each that a server did not send again.

    A page's time is its id, and its tag and date change with its id's last digits, so that
    pages of one address tell all outcomes apart. Pages whose id leaves 1 by 7 were
    only revisited.
    """
    page, day = F.col("page_id"), F.col("page_id") % 5
    tag = F.concat(F.lit('"v'), (page % 2).cast("string"), F.lit('"'))
    date = F.concat(F.lit("day "), day.cast("string"))
    sent = F.create_map(
        F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"),
        F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("age"), F.lit("0"),
    )
    kept = F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.lit("0"), F.lit("age"), (page % 100).cast("string"))
    response = F.struct(
        (2 * page).alias("record_id"), (10 * page).alias("time"), F.lit("response").alias("kind"),
        F.when(page % 11 == 3, 404).otherwise(200).alias("status"), sent.alias("headers"),
    )
    revisit = F.struct(
        (2 * page + 1).alias("record_id"), (10 * page + 5).alias("time"), F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"), kept.alias("headers"),
    )
    both = F.when(page % 7 == 1, F.array(revisit)).otherwise(F.array(response, revisit))
    return pages.select("url", F.inline(both))


@query
def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response that each revisit stands for, with its merged headers."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    done = revisits.resolve(page_captures(pages))
    names = ("etag", "last-modified", "content-type", "content-length", "age")
    headers = [F.col("headers")[x].alias(x.replace("-", "_")) for x in names]
    return done.select("record_id", "refers_to", "outcome", *headers)


@query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families that each document names, and its number of notices."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = licences.scan(docs, licences.learn(spark, docs))
    families = F.array_join(F.array_sort(F.array_distinct("licences.family")), ",")
    return found.select("doc_id", F.size("licences").alias("n_notices"), families.alias("families"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the vocabulary of each source lies from its language and from its other sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    return source_divergence.audit(docs)


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in random order over 24 shards; copies of a text are dealt out like other rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return sharding.shuffle(docs).select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the hash tree, and whether its text still belongs there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.audit(docs)

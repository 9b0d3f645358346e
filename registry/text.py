"""Text, vocabulary and TF-IDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.functions import text as tx
from loomset.operators import corpus as cp
from loomset.operators import heavy_hitters as hh
from loomset.operators import tfidf as ti
from loomset.operators import vocab as vc
from loomset.operators.dense import class_similarity
from loomset.operators.sparse_product import sparse_class_similarity
from loomset.sources.storage import stored
from registry import query
from registry.fixtures import corpus, documents, r6, saved_vocab, table, word_counts, word_vectors
from registry.sql import CLEAN, KEPT, PUNCT_PATTERN, PUNCT_TOKENS, TERMS, TFIDF, VOCAB, VOCAB_512, WORD_COUNT, WORD_VECTORS


@query("text_concat", "SELECT doc_id, source || ' ' || text AS text FROM documents")
def text_concat(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.text_concat(F.col("source"), F.col("text")).alias("text")
    )


@query("text_snippet", "SELECT doc_id, left(text, 512) AS s512, left(text, 250) AS s250, left(text, 150) AS s150 FROM documents")
def text_snippet(spark, sf_dir):
    sizes = [tx.text_snippet(F.col("text"), n).alias(f"s{n}") for n in (512, 250, 150)]
    return table(spark, sf_dir, "documents").select("doc_id", *sizes)


@query("prompt_template", "SELECT DISTINCT p_brand AS name, 'A movie poster of the genre ' || p_brand AS prompt FROM part")
def prompt_template(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return brands.withColumn("prompt", tx.prompt(F.col("name")))


@query(
    "clean_tokens",
    f"SELECT doc_id, len({CLEAN}) AS n_tokens, array_to_string({CLEAN}, '|') AS tokens FROM documents",
)
def clean_tokens(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", tx.clean_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@query(
    "remove_stopwords",
    f"""SELECT doc_id, len(c) - len(k) AS n_removed, array_to_string(k, '|') AS tokens
    FROM (SELECT doc_id, {CLEAN} AS c, {KEPT} AS k FROM documents)""",
)
def remove_stopwords(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", tx.clean_tokens(F.col("text")).alias("c"))
    kept = docs.withColumn("k", tx.remove_stopwords(F.col("c"), tx.default_stop_words()))
    removed = (F.size("c") - F.size("k")).cast("bigint")
    return kept.select("doc_id", removed.alias("n_removed"), F.array_join("k", "|").alias("tokens"))


@query("clean_text", f"SELECT doc_id, array_to_string({KEPT}, ' ') AS clean_text FROM documents")
def clean_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", tx.clean_text(F.col("tokens")).alias("clean_text"))


@query("word_count", f"SELECT doc_id, CAST({WORD_COUNT} AS INTEGER) AS word_count FROM documents")
def word_count(spark, sf_dir):
    return word_counts(spark, sf_dir)


@query(
    "tokenize_words_punct",
    f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT doc_id, {PUNCT_TOKENS} AS t FROM documents)""",
)
def tokenize_words_punct(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", tx.tokenize_words_punct(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(
    "vocabulary_richness",
    f"WITH {TERMS} SELECT d.lang, count(DISTINCT term) AS unique_words "
    "FROM documents d LEFT JOIN terms t ON t.doc_id = d.doc_id GROUP BY d.lang",
)
def vocabulary_richness(spark, sf_dir):
    return cp.vocabulary_richness(corpus(spark, sf_dir), "lang", "tokens")


TOP_BIGRAMS = f"""WITH {TERMS},
    pairs AS (SELECT lang, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS bigram FROM terms),
    counts AS (SELECT lang, bigram, count(*) AS n FROM pairs WHERE bigram IS NOT NULL GROUP BY lang, bigram)
    SELECT lang, bigram, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, bigram) AS INTEGER) AS rank
    FROM counts QUALIFY rank <= 5"""


@query("top_bigrams", TOP_BIGRAMS)
def top_bigrams(spark, sf_dir):
    return cp.top_bigrams(corpus(spark, sf_dir), "lang", "tokens")


@query("top_bigrams_bounded", TOP_BIGRAMS)
def top_bigrams_bounded(spark, sf_dir):
    """The same rows from summaries of bounded size and an exact count of the candidates."""
    return hh.top_counts(corpus(spark, sf_dir), "lang", tx.bigrams(F.col("tokens")), "bigram")


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    weights = ti.tfidf_weights(docs, ti.fit_tfidf(docs, "tokens"), "doc_id", "tokens")
    return weights.withColumn("weight", r6("weight"))


def _class_means(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    model = ti.fit_tfidf(docs, "tokens")
    return ti.class_mean_vectors(docs, model, "lang", "tokens"), model


@query("class_mean_tfidf", f"WITH {TFIDF} SELECT lang, term, round(mean_weight, 6) AS mean_weight FROM means")
def class_mean_tfidf(spark, sf_dir):
    means, model = _class_means(spark, sf_dir)
    return ti.class_mean_weights(means, model, "lang").withColumn("mean_weight", r6("mean_weight"))


@query(
    "tfidf_top_terms",
    f"""WITH {TFIDF}, scored AS (SELECT lang, term, round(mean_weight, 6) AS score FROM means)
    SELECT lang, term, score,
           CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS INTEGER) AS rank
    FROM scored QUALIFY rank <= 5""",
)
def tfidf_top_terms(spark, sf_dir):
    means, model = _class_means(spark, sf_dir)
    return ti.top_terms(ti.class_mean_weights(means, model, "lang"), "lang")


@query(
    "class_similarity_text",
    f"""WITH {TFIDF},
    norms AS (SELECT lang, sqrt(sum(mean_weight * mean_weight)) AS n FROM means GROUP BY lang),
    dots AS (SELECT x.lang AS a, y.lang AS b, sum(x.mean_weight * y.mean_weight) AS d
             FROM means x JOIN means y ON x.term = y.term GROUP BY x.lang, y.lang)
    SELECT l.lang AS a, r.lang AS b, round(coalesce(d / nullif(na.n * nb.n, 0), 0), 6) AS similarity
    FROM sizes l CROSS JOIN sizes r LEFT JOIN dots ON dots.a = l.lang AND dots.b = r.lang
    LEFT JOIN norms na ON na.lang = l.lang LEFT JOIN norms nb ON nb.lang = r.lang""",
)
def class_similarity_text(spark, sf_dir):
    means, _ = _class_means(spark, sf_dir)
    return class_similarity(means, "lang").withColumn("similarity", r6("similarity"))


@query(
    "class_similarity_sparse",
    f"""WITH {TFIDF},
    norms AS (SELECT lang, sqrt(sum(mean_weight * mean_weight)) AS n FROM means GROUP BY lang)
    SELECT x.lang AS a, y.lang AS b, round(sum(x.mean_weight * y.mean_weight) / (max(na.n) * max(nb.n)), 6) AS similarity
    FROM means x JOIN means y ON x.term = y.term JOIN norms na ON na.lang = x.lang JOIN norms nb ON nb.lang = y.lang
    GROUP BY x.lang, y.lang""",
)
def class_similarity_sparse(spark, sf_dir):
    """Class pairs that share a term, from sparse weights through inverted lists."""
    means, model = _class_means(spark, sf_dir)
    weights = stored(ti.class_mean_weights(means, model, "lang"), "class-weights")
    return sparse_class_similarity(weights, "lang", "term", "mean_weight").withColumn("similarity", r6("similarity"))


@query("build_vocab", f"WITH {VOCAB_512} SELECT token, CAST(id AS BIGINT) AS id FROM vocab")
def build_vocab(spark, sf_dir):
    return vc.build_vocab(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", 512).select("token", "id")


@query(
    "build_vocab_whole_text",
    f"""WITH firsts AS (
      SELECT token, min(row(doc_id, pos)) AS seen FROM (
        SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
        FROM (SELECT doc_id, {PUNCT_TOKENS} AS t FROM documents)) GROUP BY token)
    SELECT token, CAST(row_number() OVER (ORDER BY seen) + 1 AS BIGINT) AS id FROM firsts
    UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', 1""",
)
def build_vocab_whole_text(spark, sf_dir):
    return vc.build_vocab(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", None).select("token", "id")


@query(
    "vocab_lookup",
    f"""WITH {VOCAB},
    tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
               FROM (SELECT doc_id, {PUNCT_TOKENS} AS t FROM documents))
    SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (v.id IS NULL) AS n_unknown,
           CAST(sum(coalesce(v.id, 1)) AS BIGINT) AS id_sum, CAST(sum(coalesce(v.id, 1) * pos) AS BIGINT) AS id_checksum
    FROM tokens LEFT JOIN vocab v USING (token) GROUP BY doc_id""",
)
def vocab_lookup(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    cut = stored(docs.select("doc_id", tx.tokenize_words_punct(F.col("text")).alias("tokens")), "tokens")
    vocab = stored(vc.build_token_vocab(cut, "doc_id", F.col("tokens")), "vocab")
    found = vc.vocab_lookup(cut.select("doc_id", F.posexplode("tokens").alias("pos", "token")), vocab)
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(F.col("token_id") == vc.UNK).alias("n_unknown"),
        F.sum("token_id").alias("id_sum"),
        F.sum(F.col("token_id") * (F.col("pos") + 1)).alias("id_checksum"),
    )


@query(
    "encode_sequences",
    f"""WITH {VOCAB_512},
    firsts100 AS (SELECT doc_id, list_slice(regexp_extract_all(lower(left(text, 512)), '{PUNCT_PATTERN}'), 1, 100) AS t
                  FROM documents),
    coded AS (SELECT doc_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
              FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM firsts100)
              LEFT JOIN vocab v USING (token) GROUP BY doc_id)
    SELECT d.doc_id, d.lang, CAST(len(coalesce(ids, [])) AS INTEGER) AS n_tokens,
           array_to_string(list_resize(coalesce(ids, []), 100, 0), ',') AS input_ids,
           repeat('1', len(coalesce(ids, []))) || repeat('0', 100 - len(coalesce(ids, []))) AS attention_mask
    FROM documents d LEFT JOIN coded USING (doc_id)""",
)
def encode_sequences(spark, sf_dir):
    docs, vocab = documents(spark, sf_dir, "doc_id", "lang", "text"), saved_vocab(spark, sf_dir, 512)
    coded = vc.encode_sequences(docs, "doc_id", "text", vocab, max_chars=512, keep=["lang"])
    return coded.select(
        "doc_id",
        "lang",
        "n_tokens",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"),
    )


@query(
    "attention_mask",
    f"""SELECT doc_id, rpad(repeat('1', least(n, 100)), 100, '0') AS mask100,
               rpad(repeat('1', least(n, 128)), 128, '0') AS mask128
    FROM (SELECT doc_id, len({PUNCT_TOKENS}) AS n FROM documents)""",
)
def attention_mask(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", F.size(tx.tokenize_words_punct(F.col("text"))).alias("n")
    )
    masks = [
        F.array_join(vc.attention_mask(F.col("n"), k).cast("array<string>"), "").alias(f"mask{k}") for k in (100, 128)
    ]
    return docs.select("doc_id", *masks)


def _checked(vector):
    """A vector as its length, first entry and sum."""
    values = vector.cast("array<double>")
    return [
        F.size(values).alias("dim"),
        r6(F.get(values, F.lit(0))).alias("first"),
        r6(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
    ]


SQL_CHECKED = (
    "CAST(len({v}) AS INTEGER) AS dim, round(CAST({v}[1] AS DOUBLE), 6) + 0.0 AS first, "
    "round(list_sum(CAST({v} AS DOUBLE[])), 6) + 0.0 AS total"
)


@query(
    "word_vector_lookup",
    f"""WITH {VOCAB}, {WORD_VECTORS}
    SELECT token, vector IS NULL AS oov, {SQL_CHECKED.format(v='vector')}
    FROM vocab LEFT JOIN word_vectors ON word = token""",
)
def word_vector_lookup(spark, sf_dir):
    vocab = saved_vocab(spark, sf_dir)
    found = vc.word_vector_lookup(vocab, word_vectors(spark, sf_dir))
    hit = F.when(~F.col("oov"), F.col("vector"))
    return found.select("token", "oov", *_checked(hit))


@query(
    "embedding_matrix",
    f"""WITH {VOCAB}, {WORD_VECTORS}
    SELECT CAST(id AS BIGINT) AS id, token, vector IS NULL AS oov, 64 AS width, {SQL_CHECKED.format(v='vector')}
    FROM vocab LEFT JOIN word_vectors ON word = token""",
)
def embedding_matrix(spark, sf_dir):
    """The random rows differ by engine, so only their width and flag are compared."""
    vocab = saved_vocab(spark, sf_dir)
    matrix = vc.embedding_matrix(vocab, word_vectors(spark, sf_dir), dim=64)
    hit = F.when(~F.col("oov"), F.col("vector"))
    return matrix.select("id", "token", "oov", F.size("vector").alias("width"), *_checked(hit))

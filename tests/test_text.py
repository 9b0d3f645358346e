"""Token expressions, vocabulary, TF-IDF."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomset.functions import text as tx
from loomset.operators import corpus as cp
from loomset.operators import tfidf as ti
from loomset.operators import vocab as vc
from loomset.operators.dense import class_similarity

TEXTS = [
    "",
    None,
    "café abc1 foo_bar dog dogs",
    "The cat, the DOG; it's 3 o'clock...",
    "one two three\tfour\nfive",
    "naïve ΑΒΓ 日本語 x² ½ Ünïcode_word",
    "abc",
    "ab abc abcd ABCDE",
]


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id INT, text STRING").coalesce(2)


def test_clean_tokens_match_python(texts):
    got = dict(rows(texts.select("id", tx.clean_tokens(F.col("text")).alias("t")), "id", "t"))
    for i, text in enumerate(TEXTS):
        assert got[i] == ([] if text is None else re.findall(r"\b[a-z]{3,}\b", text.lower()))
    assert got[2] == ["dog", "dogs"]


def test_words_and_punctuation_match_python(texts):
    got = dict(rows(texts.select("id", tx.tokenize_words_punct(F.col("text")).alias("t")), "id", "t"))
    for i, text in enumerate(TEXTS):
        assert got[i] == ([] if text is None else re.findall(r"\w+|[^\w\s]", text.lower()))


def test_word_count_splits_like_python(texts):
    got = dict(rows(texts.select("id", tx.word_count(F.col("text")).alias("n")), "id", "n"))
    for i, text in enumerate(TEXTS):
        assert got[i] == (None if text is None else len(text.split()))


def test_stopwords_keep_duplicates(spark):
    df = spark.createDataFrame([(["the", "dog", "the", "dog"],), ([],), (["the"],)], "t ARRAY<STRING>")
    got = [r[0] for r in df.select(tx.remove_stopwords(F.col("t"), ["the"])).collect()]
    assert got == [["dog", "dog"], [], []]
    assert "the" in tx.default_stop_words()


def test_concat_and_snippet_nulls(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "x STRING, y STRING")
    assert [r[0] for r in df.select(tx.text_concat(F.col("x"), F.col("y"))).collect()] == ["a b", None, None]
    assert [r[0] for r in df.select(tx.text_snippet(F.col("x"), 2)).collect()] == ["a", "na", "a"]


def test_bigrams_of_short_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t ARRAY<STRING>")
    assert [r[0] for r in df.select(tx.bigrams(F.col("t"))).collect()] == [["a b", "b c"], [], []]


def test_top_bigrams_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("x", ["a", "b", "a", "b"]), ("x", ["c", "d"]), ("y", ["z"])], "k STRING, t ARRAY<STRING>")
    assert rows(cp.top_bigrams(df, "k", "t", 2), "k", "bigram", "n", "rank") == [("x", "a b", 2, 1), ("x", "b a", 1, 2)]


def test_richness_counts_empty_category(spark):
    df = spark.createDataFrame([("x", ["a", "b", "a"]), ("y", []), ("z", ["a", "c"])], "k STRING, t ARRAY<STRING>")
    assert rows(cp.vocabulary_richness(df, "k", "t"), "k", "unique_words") == [("x", 2), ("z", 2), ("y", 0)]
    assert len(cp.vocabulary_richness(df, "k", "t", approximate=True).collect()) == 3


# --- TF-IDF -----------------------------------------------------------------------

DOCS = [
    (0, "x", ["cat", "dog", "cat"]),
    (1, "x", ["dog", "emu"]),
    (2, "y", ["emu", "emu", "fox"]),
    (3, "y", []),
    (4, "z", []),
]


def brute_tfidf(docs, k):
    totals = Counter(t for _, _, toks in docs for t in toks)
    kept = sorted(totals, key=lambda t: (-totals[t], t))[:k]
    df = {t: sum(t in toks for _, _, toks in docs) for t in kept}
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, _, toks in docs:
        w = {t: c * idf[t] for t, c in Counter(toks).items() if t in idf}
        size = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / size for t, v in w.items()})
    return out


@pytest.mark.parametrize("k", [1, 3, 5000])
def test_tfidf_against_brute_force(spark, k):
    df = spark.createDataFrame(DOCS, "id INT, k STRING, t ARRAY<STRING>")
    model = ti.fit_tfidf(df, "t", k)
    got = {(i, t): w for i, t, w in rows(ti.tfidf_weights(df, model, "id", "t"), "id", "term", "weight")}
    assert got == pytest.approx(brute_tfidf(DOCS, k))


def test_class_means_count_empty_documents(spark):
    df = spark.createDataFrame(DOCS, "id INT, k STRING, t ARRAY<STRING>")
    model = ti.fit_tfidf(df, "t")
    means = ti.class_mean_vectors(df, model, "k", "t")
    got = {(k, t): w for k, t, w in rows(ti.class_mean_weights(means, model, "k"), "k", "term", "mean_weight")}
    want = Counter()
    for (i, t), w in brute_tfidf(DOCS, 5000).items():
        want[(DOCS[i][1], t)] += w / 2
    assert got == pytest.approx(dict(want))
    top = rows(ti.top_terms(ti.class_mean_weights(means, model, "k"), "k", 1), "k", "term")
    assert top == [("x", "dog"), ("y", "emu")]
    sim = {(a, b): s for a, b, s in rows(class_similarity(means, "k"), "a", "b", "similarity")}
    assert len(sim) == 9 and sim[("x", "x")] == pytest.approx(1) and sim[("z", "z")] == 0 and sim[("x", "z")] == 0


def test_tfidf_without_terms(spark):
    df = spark.createDataFrame([(1, [])], "id INT, t ARRAY<STRING>")
    model = ti.fit_tfidf(df, "t")
    assert model.terms == [] and not ti.tfidf_weights(df, model, "id", "t").collect()


# --- vocabulary -------------------------------------------------------------------

SENTENCES = [(5, "b a! b"), (2, "a, c c"), (9, ""), (7, "D d e" + " f" * 300), (8, None)]


def brute_vocab(docs, max_chars=None):
    vocab = {"<pad>": 0, "<unk>": 1}
    for _, text in sorted(docs):
        for token in re.findall(r"\w+|[^\w\s]", (text or "")[:max_chars].lower()):
            vocab.setdefault(token, len(vocab))
    return vocab


def test_vocab_in_first_seen_order(spark):
    df = spark.createDataFrame(SENTENCES, "id INT, text STRING").repartition(3)
    assert dict(rows(vc.build_vocab(df, "id", "text"), "token", "id")) == brute_vocab(SENTENCES)
    assert dict(rows(vc.build_vocab(df, "id", "text", 3), "token", "id")) == brute_vocab(SENTENCES, 3)


@pytest.mark.parametrize("limit, hot", [(1_000_000, 1), (0, 1), (0, 3), (0, 10_000)])
def test_lookup_is_the_same_on_every_path(spark, limit, hot):
    vocab = vc.build_vocab(spark.createDataFrame(SENTENCES, "id INT, text STRING"), "id", "text")
    known = brute_vocab(SENTENCES)
    tokens = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["a", "zzz", None, "b", "<pad>", "f"] * 40)], "n INT, token STRING"
    )
    got = rows(vc.vocab_lookup(tokens, vocab, max_entries=limit, hot_tokens=hot), "token", "token_id")
    assert len(got) == 240
    for token, value in got:
        want = None if token is None else 1 if token == "<pad>" else known.get(token, 1)
        assert value == want


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_encoded_length_mask_and_padding(spark, limit):
    df = spark.createDataFrame(SENTENCES, "id INT, text STRING")
    known = brute_vocab(SENTENCES)
    vocab = vc.build_vocab(df, "id", "text")
    assert vc.encode_sequences(df, "id", "text", vocab, max_entries=limit).count() == len(SENTENCES)
    for r in vc.encode_sequences(df, "id", "text", vocab, length=10, max_entries=limit).collect():
        text = dict(SENTENCES)[r["id"]] or ""
        ids = [known[t] for t in re.findall(r"\w+|[^\w\s]", text.lower())][:10]
        assert r["n_tokens"] == len(ids)
        assert r["input_ids"] == ids + [0] * (10 - len(ids))
        assert r["attention_mask"] == [1] * len(ids) + [0] * (10 - len(ids))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_rows_that_repeat_an_id_are_encoded_apart(spark, limit):
    df = spark.createDataFrame([(1, "a b"), (1, "b"), (1, "b"), (2, None)], "id INT, text STRING")
    vocab = vc.build_vocab(df, "id", "text")
    got = vc.encode_sequences(df, "id", "text", vocab, length=3, max_entries=limit)
    assert sorted((r["id"], r["n_tokens"]) for r in got.collect()) == [(1, 1), (1, 1), (1, 2), (2, 0)]


def test_a_hot_unknown_token_is_answered_where_it_is(spark):
    words = ["unknown"] * 900 + [f"w{i % 50}" for i in range(100)]
    tokens = spark.createDataFrame(list(enumerate(words)), "n INT, token STRING")
    vocab = spark.createDataFrame([(f"w{i}", i + 2, 1) for i in range(40)], "token STRING, id BIGINT, n_docs BIGINT")
    found = vc.vocab_lookup(tokens, vocab, max_entries=0, hot_tokens=1)
    assert found.count() == 1000 and found.where("token_id = 1").count() == 900 + 20


def test_embedding_matrix_rows(spark):
    vocab = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("cat", 2), ("dog", 3)], "token STRING, id BIGINT")
    vectors = spark.createDataFrame([("cat", [1.0, 2.0])], "word STRING, vector ARRAY<FLOAT>")
    first = {r["token"]: r for r in vc.embedding_matrix(vocab, vectors, 2).collect()}
    again = {r["token"]: r for r in vc.embedding_matrix(vocab.repartition(3), vectors, 2).collect()}
    assert first == again
    assert first["cat"]["vector"] == [1.0, 2.0] and not first["cat"]["oov"]
    assert first["dog"]["oov"] and first["dog"]["vector"] != first["<unk>"]["vector"]
    zero = {r["token"]: r for r in vc.embedding_matrix(vocab, vectors, 2, zero_pad=True).collect()}
    assert zero["<pad>"]["vector"] == [0.0, 0.0] and zero["dog"] == first["dog"]
    assert vc.oov_rate(vc.embedding_matrix(vocab, vectors, 2)).first()["oov_rate"] == 0.75


def test_random_vectors_look_normal(spark):
    draws = spark.range(200).select(F.explode(vc.random_normal_vector(F.col("id").cast("string"), 100, 1)).alias("x"))
    mean, sd, top = draws.agg(F.avg("x"), F.stddev("x"), F.max(F.abs("x"))).first()
    assert abs(mean) < 0.03 and abs(sd - 1) < 0.03 and 3 < top < 7


def test_a_vocabulary_of_few_but_long_tokens_is_not_broadcast(spark):
    long = "x" * 4000
    vocab = spark.createDataFrame([("<pad>", 0, 0), ("<unk>", 1, 0), (long, 2, 1), ("a", 3, 1)], "token STRING, id BIGINT, n_docs BIGINT")
    rows = spark.createDataFrame([(1, long), (2, "a"), (3, "b"), (4, None), (5, long)], "id INT, token STRING")
    assert not vc.is_local(vocab, "token", 100, 1000) and vc.is_local(vocab, "token", 100, 10_000)
    for size in (1000, 10_000):
        got = {r["id"]: r["token_id"] for r in vc.vocab_lookup(rows, vocab, max_bytes=size).collect()}
        assert got == {1: 2, 2: 3, 3: 1, 4: None, 5: 2}

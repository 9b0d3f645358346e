"""The pipeline operators: contracts against plain Python, and null, empty, repeated and long rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomset.llm import (
    components, html_render, licences, near_dedup, packing, piece_encoding, quality_rules, queries, revisits,
    rule_ensemble, shingles, token_lengths, vector_search,
)

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, lang string, n_chars long, quality int, stats string, key string, row int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and very long texts, with columns that clash."""
    texts = [None, "", " \n ", "a b", words(300, 1), words(300, 1), words(60_000, 2), "é 漢字 😀 \x00 x"]
    rows = [(i if i != 3 else None, t, None if i % 3 else "h", "en", 1, 1, "s", "k", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4]], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_quality_counts(spark, odd, none):
    done = quality_rules.judge(odd)
    assert done.columns == ["doc_id", "source", "lang", "n_chars", "stats", "key", "row", "quality"]
    got = {r.row: r.quality for r in done.collect()}
    assert done.count() == 9 and [got[i].n_words for i in range(8)] == [0, 0, 0, 2, 300, 300, 60_000, 5]
    assert got[0].base_failed and not got[0].kept and got[6].kept
    assert not quality_rules.judge(none).collect() and not quality_rules.clean(none).collect()
    text = " ".join(["a b c d e f g h i"] * 2 + ["x y"])
    df = spark.createDataFrame([(1, text + "\n\nL\nL", "s")], "doc_id int, text string, source string")
    q = quality_rules.judge(df).first().quality
    assert (q.n_words, q.n_repeat_words, q.n_dup_lines) == (22, 18, 1)


def test_frequent_lines_go_and_other_texts_stay_whole(spark):
    same = words(10, 5)
    rows = [(i, f"{words(30, i + 9)}\n{same}" if i % 2 else words(30, i + 9), "h", 0) for i in range(60)]
    rows += [(100, f"{same}\n{same} z\n" + "\n".join([same] * 4), "h", 0), (101, f"{words(30, 99)}\n{same}", "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, n_chars int")
    got = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert set(got) == {*range(60), 101}
    for i, text, _, _ in rows:
        if i in got:
            want = text if i == 101 else text.split("\n")[0]
            assert got[i].text == want and got[i].n_chars == len(want)


def test_rule_ensemble(spark, odd, none):
    limits = (("a", True, 2.0), ("b", False, 1.0))
    model = rule_ensemble.RuleEnsemble(-1.0, ((limits, 3.0),))
    df = spark.sql("SELECT named_struct('a', a, 'b', b) AS s FROM VALUES (2D, 2D), (3D, 2D) AS t(a, b)")
    assert [round(r[0], 4) for r in df.select(model.score(F.col("s"))).collect()] == [0.8808, 0.2689]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    flat = rule_ensemble.learn(odd, labels)
    scores = [r.quality.score for r in rule_ensemble.classify(odd, flat).collect()]
    assert scores == [0.5] * 9 and not rule_ensemble.classify(none, flat).collect()
    got = queries.QUERIES["op3_rule_ensemble"](spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(truth, on="doc_id")
    both = both[both.held_out]
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (both.predicted == both.quality).mean() > 0.95


def test_shingles_equal_plain_ones(spark):
    import pyarrow as pa

    texts = ["a b c d e f", None, "", "a b", "a b c d e a b c d e", "  b c\td e\nf  "]
    row, ids, times = shingles.counted(shingles.shingle_keys(pa.array(texts)))
    name = {}
    for i, text in enumerate(texts):
        w = (text or "").split()
        plain = defaultdict(int)
        for k in range(max(1, len(w) - 4) if w else 0):
            plain[tuple(w[k : k + 5])] += 1
        assert sorted(times[row == i]) == sorted(plain.values())
        for s in ids[row == i] if len(plain) == 1 else []:
            assert name.setdefault(s, next(iter(plain))) == next(iter(plain))
    assert set(ids[row == 5]) <= set(ids[row == 0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (103, 103)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_near_dedup_against_all_pairs(spark, odd, none):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: r.text.split() for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in held.items()}
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op7_near_dedup"](spark, SF).collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a in sets:
        for b in sets:
            if a < b and alike(a, b) >= 0.83:
                assert got[a] == got[b]
            elif got[a] == got[b] == a:
                assert alike(a, b) >= 0.6 or len([i for i in got if got[i] == a]) > 2
    done = near_dedup.classes(odd).collect()
    assert len(done) == 9 and {r.class_id for r in done if r.doc_id in (4, 5)} == {4}
    assert not near_dedup.classes(none).collect()
    assert near_dedup.keep_one(odd).count() == 7 and near_dedup.keep_one(odd).columns == odd.columns


def test_near_dedup_bound_loses_no_link(spark):
    draw = np.random.default_rng(7)
    base = [f"w{i}" for i in range(300)]
    texts = [
        " ".join("x" + str(draw.integers(1 << 40)) if draw.random() < rate else w for w in base)
        for rate in (0.005, 0.02, 0.03) for _ in range(25)
    ]
    bodies = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    key = F.struct(F.col("key").alias("a"), F.col("key").alias("b"))
    bodies = bodies.select(key.alias("key"), "text")
    members = bodies.select(F.lit(1).cast("long").alias("bucket"), F.col("key").alias("text"))
    names = spark.createDataFrame([], "node struct<a:long,b:long>, component struct<a:long,b:long>")
    weights = near_dedup.Weights(np.zeros(0, np.uint64), np.zeros(0), len(texts))
    opened = near_dedup.open_pairs(members, names, bodies, weights, 0.8).select("a.a", F.col("b.a").alias("b")).collect()
    opened = {(r.a, r.b) for r in opened}
    sets = [Counter(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    like = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total()}
    assert like and like <= opened and len(opened) < len(texts) * (len(texts) - 1) / 4


def test_packing(spark, odd, none):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, key in ((docs, "doc_id"), (odd.drop("doc_id").distinct(), "row")):
        got = packing.pack_documents(df, RANKS, key=key).toPandas()
        sizes = got.groupby("sequence_id").length.sum()
        assert ((sizes == 1024) | ((sizes < 1024) & (sizes > 1016)) | ((sizes & (sizes - 1)) == 0)).all()
        ordered = got.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
        pieces = {k: g.sort_values("start") for k, g in got.groupby(key)}
        for r in df.collect():
            ids = [*known.encode(r.text or "", add_special_tokens=False).ids, 0]
            assert np.frombuffer(b"".join(pieces[r[key]].ids), "<u4").tolist() == ids
            assert (pieces[r[key]].doc_tokens == len(ids)).all()
    assert packing.pack_documents(odd, RANKS).groupBy("doc_id").count().count() == 8
    assert not packing.pack_documents(none, RANKS).collect()


def test_piece_encoding(spark, odd, none):
    known = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "   a  b", "\n", "▁▁x", "int main() {\n    return 0;\n}", " " * 40, "ababab" * 20, "😀 é\x00", "<s>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    done = piece_encoding.decode(piece_encoding.encode(df, MODEL), MODEL)
    for r in done.collect():
        want = known.encode(texts[r.i], add_eos=True)
        assert r.ids == want and r.decoded == known.decode(want)
    pieces = piece_encoding.Pieces.load(MODEL)
    encoder = piece_encoding.PieceEncoder(pieces, piece_encoding.MergeTable.build(pieces))
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("abcdetion ,.é漢\n{}") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == known.encode(text, add_eos=True)
        ids = [rng.randrange(1, 32_000) for _ in range(8)]
        assert encoder.decode(ids) == known.decode(ids)
    assert piece_encoding.encode(odd, MODEL).count() == 9 and not piece_encoding.encode(none, MODEL).collect()
    one = queries.QUERIES["op9_piece_encoding"](spark, SF).filter("doc_id = 0").first()
    ids = known.encode(texts[0], add_eos=True)
    assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_token_lengths(spark, odd, none):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [len(known.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()]
    for r in queries.QUERIES["op8_token_lengths"](spark, SF).collect():
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
    histogram = token_lengths.length_histogram(token_lengths.encoded_lengths(docs, RANKS))
    for r in token_lengths.at_limits(histogram, [0, 100, 1024]).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in n)
        assert r.docs_over == sum(x > r.context_limit for x in n)
    half = token_lengths.quantiles(token_lengths.suffix_sums(histogram), [0.5]).first().n_tokens
    assert half == sorted(n)[(len(n) + 1) // 2 - 1]
    assert not token_lengths.suffix_sums(token_lengths.length_histogram(token_lengths.encoded_lengths(none, RANKS))).collect()
    assert token_lengths.encoded_lengths(odd, RANKS).count() == 9


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(50, None), (100, [1.0, None]), (2000, [float("inf")]), (150, []), (200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vector_search.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 250, 1000, 1050):
        own = next(v for i, v in whole if i == q)
        best = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in best]
    assert not vector_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect()


def test_html(spark):
    page = "<p>a<p>b <b>c</b><br>d<ul><li>x<li>y<ol start=3><li>q</ol></ul><table><tr><th>n<th>v<tr><td>long<td>2</table>"
    page += "<div style='display: none'>no</div><pre>k\n  l</pre><script>z</script>t &lt; 3"
    want = "a\n\nb c\nd\n\n- x\n- y\n  3. q\n\nn    | v\nlong | 2\n\nk\n  l\n\nt < 3"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div>" * 5000 + "deep"), (4, "no < markup")], "rendered int, html string")
    got = html_render.extract(df.withColumnRenamed("rendered", "page_id")).collect()
    assert [r.rendered for r in got] == [want, None, "", "deep", "no < markup"]
    assert html_render.extract(df).columns == ["rendered"] and not html_render.extract(df.limit(0)).collect()


def test_revisits(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        headers = {"etag": f'"{rng.randint(0, 1)}"', "content-length": str(i), "age": str(i)}
        url = rng.choice(["http://www.a.com/x/?utm_id=1", "https://a.com/x#y", "a.com/z", None])
        rows.append((i, url, rng.randint(0, 90), kind, rng.choice([200, 200, 404]), headers, "extra"))
    df = spark.createDataFrame(rows, "record_id int, url string, time int, kind string, status int, headers map<string,string>, page string")
    monkeypatch.setattr(revisits, "SLICE_ROWS", 30)
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    page = {rows[0][1]: 0, "http://www.a.com/x/?utm_id=1": 0, "https://a.com/x#y": 0, "a.com/z": 1}
    asked = [r for r in rows if r[3] == "revisit" and r[1]]
    assert set(got) == {r[0] for r in asked}
    for r in asked:
        past = [s for s in rows if s[3] == "response" and s[4] == 200 and s[1] and page[s[1]] == page[r[1]] and s[2] < r[2]]
        last = max(past, key=lambda s: (s[2], s[0]), default=None)
        g = got[r[0]]
        assert g.refers_to == (last[0] if last else None)
        assert g.outcome == ("missing" if not last else "resolved" if last[5]["etag"] == r[5]["etag"] else "mismatch")
        if g.outcome == "resolved":
            assert g.headers == {**last[5], "age": str(r[0])}
    assert not revisits.resolve(df.limit(0)).collect()
    block = spark.sql(r"SELECT 'HTTP/1.1 304 X\r\nETag: \"a\"\r\nAge: 1\r\nAge: 2' AS b")
    assert block.select(revisits.parse_headers(F.col("b"))).first()[0] == {"etag": '"a"', "age": "2"}


def test_licences(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licences.learn(spark, docs)
    lines = ["Some words here.", "Licensed under the Apache License, Version 2.0.", "xx Released under the MIT License. yy",
             "He has a driver's license and the MIT campus.", "License under general version", "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
    hits = licences.scan(df, model).first().licences
    assert [(h.paragraph, h.family) for h in hits] == [(1, "Apache-2.0"), (2, "MIT"), (5, "CC-BY-NC-4.0")]
    assert all("\n".join(lines)[h.start :][: h.length] == lines[h.paragraph] for h in hits)
    assert [len(r.licences) for r in licences.scan(odd, model).collect()] == [0] * 9
    assert not licences.scan(none, model).collect() and licences.learn(spark, none).families[-1] == "unknown"


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    classes = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    bad = {i for i, q in labels.items() if q == 0}
    assert len(kept & bad) < 0.05 * len(bad)
    assert len([i for i in kept if labels.get(i) == 1]) > 0.9 * len({classes[i] for i, q in labels.items() if q == 1})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "packing"]

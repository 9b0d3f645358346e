"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomset.llm import licences, near_dedup, packing, piece_encoding, quality_rules, token_lengths

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_one_of_a_large_group_of_near_copies_leaves_the_pipeline(spark):
    lines, foot = [words(20, 500 + k) for k in range(10)], words(12, 999)
    rows = [(i, f"{words(60, i)}\n{foot}", "h") for i in range(40)]
    for i in range(300):
        copy = [x.split() for x in lines]
        if i:
            copy[i % 10][(i // 10) % 20] = f"edit{i}"
        rows.append((1000 + i, "\n".join(" ".join(x) for x in copy), "h"))
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    cleaned = corpus_pipeline.quality_rules_stage(spark, docs, "")
    got = {r.doc_id: r.text for r in corpus_pipeline.near_dedup_stage(spark, cleaned, "").collect()}
    assert len([i for i in got if i >= 1000]) == 1 and set(range(40)) <= set(got)
    assert all(got[i] == words(60, i) for i in range(40))
    kept = quality_rules.clean(docs).select("doc_id")
    assert kept.filter(F.col("doc_id") >= 1000).count() == 0  # exact copies alone are folded in the rule of the SQL
    assert near_dedup.keep_one(docs).count() == 41


def same_ids(spark, texts):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [known.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pieces = packing.pack_documents(docs, RANKS).toPandas().sort_values(["doc_id", "start"])
    for i, ids in enumerate(want):
        own = pieces[pieces.doc_id == i]
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == [*ids, 0] and (own.doc_tokens == len(ids) + 1).all()
    lengths = [r.n_tokens for r in token_lengths.encoded_lengths(docs, RANKS).collect()]
    assert sorted(lengths) == sorted(map(len, want))


def test_end_of_text_in_a_text_is_one_token(spark):
    same_ids(spark, ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "x  \n<|endoftext|>", "<|endoftext|", "plain"])


def test_very_long_runs_of_white_space_are_encoded(spark):
    n = 1_100_000
    same_ids(spark, [" " * n + "x", "\n" * n + "12", "a" + " \t\n" * (n // 3) + "b", "\t" * n + "<|endoftext|>" + " " * n + "'s"])


def test_wrapped_licence_headers_are_notices(spark):
    apache = """# Licensed under the Apache License,
# Version 2.0 (the "License"); you may not use
# this file except in compliance with the License.
"""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
    bsd = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
"""
    mit = """Permission is hereby granted, free of charge,
to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal
"""
    prose = "Some words stand here\nand the work goes on under the\nterms of the day.\n"
    whole = "\n".join([prose, apache, gpl, prose, bsd, mit, prose])
    model = licences.learn(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    docs = spark.createDataFrame([(1, whole), (2, gpl), (3, bsd), (4, prose)], "doc_id int, text string")
    got = {r.doc_id: r.licences for r in licences.scan(docs, model).collect()}
    assert [h.family for h in got[1]] == ["Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MIT"]
    assert [[h.family for h in got[i]] for i in (2, 3, 4)] == [["GPL-3.0"], ["BSD-3-Clause"], []]
    assert whole[got[1][2].start :][: got[1][2].length] in bsd


def test_different_texts_of_one_id_stay(spark):
    a, b, c = words(40, 1), words(40, 2), words(40, 3)
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a, 0), (1, b, 1), (2, c, 2), (3, near, 3), (1, a, 4), (1, b, 1), (4, "", 5), (4, None, 6), (4, "", 7), (None, c, 8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _row int")
    for some in (docs, docs.repartition(7)):
        got = sorted(map(str, near_dedup.keep_one(some).collect()))
        assert len(got) == 6 and got == sorted(map(str, near_dedup.keep_one(some).collect()))
        kept = [(r.doc_id, r.text) for r in near_dedup.keep_one(some).collect()]
        assert sorted(kept, key=str) == sorted([(1, a), (1, b), (2, c), (4, ""), (4, None), (None, c)], key=str)
    named = {(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()}
    assert named == {(1, 1), (2, 2), (3, 1), (4, 4), (None, 2)}


def test_licences_and_versions_are_told_apart(spark):
    fsf = "it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or"
    cases = {
        "GPL-2.0": [fsf.format("General Public License", "2"), "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL v2 license."],
        "GPL-3.0": [fsf.format("General Public License", "3"), "Released under the GPL v3 license."],
        "LGPL-2.1": [fsf.format("Lesser General Public\n License", "2.1"), "SPDX-License-Identifier: LGPL-2.1-or-later"],
        "AGPL-3.0": [fsf.format("Affero General Public License", "3")],
        "ISC": ["SPDX-License-Identifier: ISC"],
        "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the 2-clause BSD License."],
        "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 3-clause BSD License."],
        "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
        "Apache-1.1": ["Licensed under the Apache License, Version 1.1."],
        None: [
            "This is not released under the MIT License.", "Licensed under the Apache License, Version 1.0.", "Licensed under CC BY 3.0.",
            "SPDX-License-Identifier: EPL-2.0", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Eclipse Public License 2.0.",
        ],
    }
    rows = [(i, text, family) for i, (family, text) in enumerate((f, t) for f, texts in cases.items() for t in texts)]
    model = licences.learn(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    docs = spark.createDataFrame(rows, "doc_id int, text string, licences string")
    want = {i: [family] if family else [] for i, _, family in rows}
    assert {r.doc_id: [h.family for h in r.licences] for r in licences.scan(docs, model).collect()} == want


def test_licence_query_finds_the_lines_that_plain_python_finds(spark):
    from loomset.llm import queries

    known = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License",
        "GPL-3.0": "licensed under the GNU General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    }
    folder = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        hits = [f for line in r.text.split("\n") for f, notice in known.items() if notice in line]
        want[r.doc_id] = (len(hits), ",".join(sorted(set(hits))))
    got = {r.doc_id: (r.n_notices, r.families) for r in queries.QUERIES["op5_licences"](spark, folder).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 10


def test_a_line_goes_at_one_limit_in_small_and_large_hosts(spark):
    passage = words(60, 77)
    rows = [(i, f"{words(90, i)}\n{passage}" if i < 25 else words(90, i), "small") for i in range(60)]
    rows += [(100 + i, f"{words(90, 100 + i)}\n{passage}" if i < 25 else words(90, 100 + i), "large") for i in range(4000)]
    rows += [(9000 + i, f"{words(90, 9000 + i)}\n{passage}" if i < 20 else words(90, 9000 + i), "few") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r.quality for r in quality_rules.judge(docs).collect()}
    for i, text, host in rows:
        assert got[i].kept and got[i].removed_words == (60 if "\n" in text and host != "few" else 0)


def test_revisits_without_a_validator_are_unchecked(spark):
    from loomset.llm import revisits

    day = {"last-modified": "d1"}
    rows = [
        (1, "http://a.com/x", 1, "response", 200, {"etag": '"1"'}), (2, "a.com/x", 2, "revisit", 304, {}), (3, "a.com/x", 2, "revisit", 304, None),
        (4, "a.com/x", 3, "revisit", 304, day), (None, "www.a.com/x", 4, "revisit", 304, {"etag": 'W/"1"'}), (None, "a.com/x", 4, "revisit", 304, {"etag": '"1"'}),
        (5, "m.a.com/x", 5, "revisit", 304, {"etag": '"1"'}), (6, "a.com/x?ref=main", 5, "revisit", 304, {"etag": '"1"'}),
        (7, "b.com", 1, "response", 200, None), (8, "b.com/", 2, "revisit", 304, {"etag": '"1"'}), (9, None, 2, "revisit", 304, {}),
    ]
    df = spark.createDataFrame(rows, "record_id int, url string, time int, kind string, status int, headers map<string,string>")
    got = sorted(((r.record_id, r.refers_to, r.outcome) for r in revisits.resolve(df).collect()), key=str)
    assert got == sorted([
        (2, 1, "unchecked"), (3, 1, "unchecked"), (4, 1, "unchecked"), (None, 1, "resolved"), (None, 1, "resolved"),
        (5, None, "missing"), (6, None, "missing"), (8, 7, "unchecked"),
    ], key=str)
    mobile = revisits.resolve(df, host_prefixes=r"^(www\d*|m)\.").filter("record_id = 5").first()
    assert (mobile.refers_to, mobile.outcome) == (1, "resolved")


def test_one_hot_page_is_ordered_in_many_ranges(spark, monkeypatch):
    from loomset.llm import revisits

    rows = [(i, "a.com", i, "response" if i % 50 == 0 else "revisit", 200, {"etag": '"1"'}) for i in range(2000)]
    df = spark.createDataFrame(rows, "record_id int, url string, time int, kind string, status int, headers map<string,string>")
    monkeypatch.setattr(revisits, "SLICE_ROWS", 60)
    got = {r.record_id: (r.refers_to, r.outcome) for r in revisits.resolve(df).collect()}
    assert got == {i: (i - i % 50, "resolved") for i in range(2000) if i % 50}


def test_packing_leaves_less_than_a_window_for_any_lengths():
    rng = random.Random(9)
    draws = {
        "ones": lambda: 1, "mid": lambda: rng.randint(300, 449), "short": lambda: rng.randint(200, 256), "long": lambda: rng.randint(600, 3000),
        "mixed": lambda: rng.choice((1, 40, 300, 700, 1024, 5000)),
    }
    for name, draw in draws.items():
        pending, placed, total, tiers = [], [], 0, set()
        for flush in range(6):
            for k in range(2000):
                n = draw()
                pending.append(packing.Piece(n, total, 0, (total, b"\0" * (4 * n))))
                total += 1
            done, pending = packing.pack(pending, flush == 5)
            assert sum(p.length for p in pending) < 1024
            for size, held in done:
                length = sum(p.length for p in held)
                assert length == size or size == 1024 and length > 1016
                tiers.add(size)
                placed += [(p.order, p.start, p.length, len(p.row[1]) // 4) for p in held]
        placed.sort()
        ends = {}
        for order, start, length, whole in placed:
            assert ends.get(order, 0) == start
            ends[order] = start + length
            assert ends[order] <= whole
        assert len(ends) == total and sum(p[2] for p in placed) == sum(w for w in {p[0]: p[3] for p in placed}.values())
        assert not pending and (name not in ("mid", "short", "ones") or {"mid": 512, "short": 256, "ones": 256}[name] in tiers)


def test_packing_query_holds_the_ids_of_tokenizers(spark):
    import zlib

    from loomset.llm import queries

    folder = "/root/testdata/sf0.001"
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op2_packing"](spark, folder).toPandas().sort_values(["doc_id", "start"])
    assert set(got.doc_id) == set(texts)
    for doc_id, own in got.groupby("doc_id"):
        ids = np.array([*known.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    sizes = got.groupby("sequence_id").length.sum()
    assert 1 - sizes.sum() / sum(s if s & (s - 1) == 0 else 1024 for s in sizes) < 0.02


def clustered(spark, n, clusters=40):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(clusters, 16)) * 4
    x = centres[np.arange(n) % clusters] + rng.normal(size=(n, 16)) * 0.05
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_few_blocks_and_products_are_visited_in_clusters(spark, monkeypatch):
    from loomset.llm import vector_search

    monkeypatch.setattr(vector_search, "BLOCK", 200)
    x, df = clustered(spark, 8000)
    whole = np.floor(256 * x).astype(np.int64)
    asked = np.arange(0, 8000, 50)
    calls, made = [], vector_search.reached_blocks
    monkeypatch.setattr(vector_search, "reached_blocks", lambda *a: calls.append((a[0], made(*a))) or calls[-1][1])
    got = vector_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    blocks, routed = calls[0][0].select("block").distinct().count(), calls[0][1].count()
    assert blocks >= 40 and routed < 0.2 * blocks * len(asked)
    scores = whole[asked] @ whole.T
    for q, row in zip(asked, scores):
        best = sorted((-s, i) for i, s in enumerate(row.tolist()) if i != q)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    # the products that one search does within the blocks it gets
    ids = np.arange(len(whole))
    drawn = np.random.default_rng(3).permutation(8000)[:1000]
    searcher = vector_search.Searcher(drawn, whole[drawn], float((whole.astype(float) ** 2).sum(1).max()), 5)
    pivot, dist = searcher.key(whole)
    done, product = [], vector_search._product
    monkeypatch.setattr(vector_search, "_product", lambda a, b: done.append(len(a) * len(b)) or product(a, b))
    monkeypatch.setattr(vector_search, "ANNULUS", 64)
    searcher.search(ids, whole, pivot, dist, asked, whole[asked])
    assert sum(done[1:]) < 0.1 * len(ids) * len(asked)


def test_blocks_that_share_a_span_are_all_reached(spark, monkeypatch):
    from loomset.llm import vector_search

    x, df = clustered(spark, 900, 9)
    whole = np.floor(256 * x).astype(np.int64)
    monkeypatch.setattr(vector_search, "BLOCK", 30)
    monkeypatch.setattr(vector_search, "MAX_SPANS", 4)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 900, 20):
        best = sorted((-s, i) for i, s in enumerate((whole @ whole[q]).tolist()) if i != q)[:5]
        assert sorted((r.rank, r.vec_id) for r in got if r.query_id == q) == [(k, i) for k, (_, i) in enumerate(best, 1)]


def test_stages_take_odd_rows(spark, tmp_path):
    texts = [None, "", " \n ", "a b", words(300, 1), words(300, 1), words(20_000, 2), "é 漢字 😀 \x00 x", words(300, 4)]
    rows = [(i if i != 4 else None, t, None if i % 3 else "h", "en", 1, 1, "s", "k", i, 0) for i, t in enumerate(texts)]
    columns = "doc_id long, text string, source string, lang string, n_chars long, quality int, stats string, key string, _row int, score int"
    docs = spark.createDataFrame([*rows, rows[5], rows[5], rows[0]], columns)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {
        "quality_rules": [None, 5, 5, 5, 6, 8], "quality_classifier": [None, 0, 0, 1, 2, 3, 5, 5, 5, 6, 7, 8],
        "near_dedup": [None, 0, 1, 2, 3, 5, 6, 7, 8],
    }
    order = lambda ids: sorted(ids, key=lambda i: (i is not None, i or 0))
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(tmp_path))
        assert not stage(spark, docs.limit(0), str(tmp_path)).collect()
        if name == "packing":
            pieces = done.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
            assert {r.doc_id: r.n / r.whole for r in pieces} == {None: 1, 0: 2, 1: 1, 2: 1, 3: 1, 5: 3, 6: 1, 7: 1, 8: 1}
        else:
            assert done.columns == docs.columns
            assert order(r.doc_id for r in done.collect()) == want[name]


def test_piece_segments_are_kept_once_for_all_words():
    """Words that differ only in their marks share a segment; no piece spans two, and ids are the library's."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    known = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = piece_encoding.Pieces.load(path)
    table = piece_encoding.MergeTable.build(pieces)
    encoder = piece_encoding.PieceEncoder(pieces, table)
    text = "stone, stone. (stone) stone; stone\nstone"
    assert np.frombuffer(encoder.encode(text), np.int32).tolist() == known.encode(text, add_eos=True)
    assert [w for w in encoder.words if "stone" in w] == ["▁stone", "stone"]
    pattern = re.compile(piece_encoding.segment_pattern(pieces), re.DOTALL)
    assert all(pattern.findall(name) == [name] for name in table.names)
    for odd in ("  Ждё一个x.", "a  😀 ", "   ", "12 a1b\t\n\n c", "▁▁«é», 据数据", "\x00 \x00"):
        ids = known.encode(odd, add_eos=True)
        assert np.frombuffer(encoder.encode(odd), np.int32).tolist() == ids and encoder.decode(ids) == known.decode(ids)


def test_shingle_weights_do_not_depend_on_the_partitions(spark):
    """A shingle of every text, and one of every fifth, are counted in texts that lie one in a partition, too."""
    rows = [(f"one two three four five {'six ' * 5 if i % 5 == 0 else ''}{words(8, seed=i)}",) for i in range(60)]
    found = []
    for n in (1, 60):
        weights = near_dedup.frequent_shingles(spark.createDataFrame(rows, "text string").repartition(n), "text")
        found.append((weights.n, dict(zip(weights.ids.tolist(), weights.values.tolist(), strict=True))))
    assert found[0] == found[1]
    assert min(found[0][1].values()) == np.log1p(60 / (60 + near_dedup.PRIOR * 60))


def test_copies_that_lie_together_do_not_fill_the_counting_of_shingles(spark, monkeypatch):
    """Twelve copies in a partition are no frequent text; the counting passes on rows a task, not a copied shingle."""
    rows = [(i // 12, f"one two three four five {words(16, seed=i // 12)}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "part int, text string").repartitionByRange(2, "part").select("text")
    kind, made = type(docs), []
    plain = kind.mapInArrow

    def watched(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(kind, "mapInArrow", watched)
    weights = near_dedup.frequent_shingles(docs, "text")
    assert weights.n == 4000 and weights.values.tolist() == [np.log1p(4000 / (4000 + near_dedup.PRIOR * 4000))]
    assert sum(made) <= 20

"""Source divergence, sharding and the hash-tree manifest against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomset.llm import merkle, queries, sharding, source_divergence

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, source string, lang string, n_chars long, item string, value int, shard string, pos int, leaf string"


def odd_rows():
    """Null, empty, blank, repeated and very long texts, null keys, columns that clash."""
    rng = random.Random(3)
    pool = ["alpha", "Beta", "GAMMA", "delta1x", "é", "漢字", "naïve", "Ünder", "z" * 3000]
    rows = []
    for i in range(400):
        text = rng.choice([None, "", " \n\t", " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))])
        rows.append((rng.randrange(300), text, rng.choice([None, "", "a", "b", "c'é"]), rng.choice([None, "en", "de"]), i, "x", 1, "y", 2, "z"))
    rows += [rows[0]] * 40 + [(None, "Alpha beta", "a", "en", None, "x", 1, "y", 2, "z")] * 3
    rows += [(7, "q" * 2_500_000 + " alpha " + "r" * 1_100_000, "a", "en", 1, "x", 1, "y", 2, "z")] * 3
    rows += [(8, None, "lonely", "nothing", 1, "x", 1, "y", 2, "z"), (9, "", "empty", "nothing", 1, "x", 1, "y", 2, "z")]
    rows += [(10, "a line one once", "single", "solo", 1, "x", 1, "y", 2, "z")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def plain_audit(rows):
    """All rows of the audit from (lang, source, text) rows."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups, df, own = set(), Counter(), Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(TERM.findall((text or "").translate(low)))
        df.update((lang, t) for t in found)
        own.update({(lang, source, t): n for t, n in found.items()})
    out = set()
    for lang in {g[0] for g in groups}:
        terms = [t for (x, t), n in df.items() if x == lang and n >= 3]
        sources = [s for x, s in groups if x == lang]
        tokens = {s: sum(own[lang, s, t] for t in terms) for s in sources}
        share = lambda n, whole: 1 + 10**9 * (n + 1) // (whole + len(terms))  # noqa: B023, E731
        p = {(s, t): share(own[lang, s, t], tokens[s]) for s in sources for t in terms}
        q = {t: share(sum(own[lang, s, t] for s in sources), sum(tokens.values())) for t in terms}
        part = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(part(p[s, t], p[o, t]) for t in terms)) for o in sources if o != s]
            kept = [(t, part(p[s, t], q[t])) for t in terms if own[lang, s, t] and p[s, t] > q[t]]
            for name, found in (("pair", pairs), ("term", kept)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                cut = found if name == "pair" else found[:200]
                out |= {(lang, s, name, item, value, rank) for rank, (item, value) in enumerate(cut, 1)}
    return out


def audited(df):
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(set(rows)) == len(rows)
    return set(map(tuple, rows))


@pytest.mark.parametrize("sent", [True, False])
def test_source_divergence(spark, odd, none, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(source_divergence, "MAX_GROUPS", 0)
    want = plain_audit([(r[3], r[2], r[1]) for r in odd_rows()])
    assert audited(source_divergence.audit(odd)) == want
    assert {x for x in want if x[0] == "nothing"} == {
        ("nothing", "lonely", "pair", "empty", 0, 1), ("nothing", "empty", "pair", "lonely", 0, 1)}
    assert not source_divergence.audit(none).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if not sent:
        want = plain_audit([tuple(r) for r in docs.select("lang", "source", "text").collect()])
        assert audited(source_divergence.audit(docs)) == want


def test_stripes_do_not_depend_on_spills_or_batches():
    rows = [(r[3] or "", r[2] or "", r[1] or "") for r in odd_rows()]
    batch = lambda some: pa.RecordBatch.from_pylist([dict(zip("abc", r)) for r in some])
    results = []
    for step, spill, cut in ((500, 1 << 30, 10_000), (7, 1, 3), (50, 20_000, 1)):
        folded = source_divergence.fold((batch(rows[i : i + step]) for i in range(0, len(rows), step)), spill)
        whole = pa.Table.from_batches(folded, source_divergence.STRIPE_ARROW).sort_by([("lang", "ascending"), ("term", "ascending")])
        merged = list(source_divergence.merge(3)(iter(whole.combine_chunks().to_batches(cut))))
        found = [r for b in merged for r in b.to_pylist()]
        results.append([(r["lang"], r["term"], r["df"], sorted((s["source"], s["n"]) for s in r["sources"])) for r in found])
    assert results[0] == results[1] == results[2] and len(results[0]) > 10
    assert max(map(len, source_divergence.words(b"q" * 3_000_000 + b" a b"))) == 3


def test_hypergeometric_counts_have_their_distribution():
    rng = np.random.default_rng(5)
    for good, bad, n in ((5, 7, 4), (1, 30, 10), (100, 3, 50), (40, 40, 40)):
        drawn = Counter(sharding.hypergeometric(u, good, bad, n) for u in rng.random(20_000))
        for k in range(max(0, n - bad), min(n, good) + 1):
            chance = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
            assert abs(drawn[k] - 20_000 * chance) < 5 * (20_000 * chance) ** 0.5 + 3
    large = [sharding.hypergeometric(u, 10**11, 23 * 10**11, 10**8) for u in rng.random(50)]
    assert abs(np.mean(large) - 10**8 / 24) < 5 * (10**8 / 24 / 50) ** 0.5
    sizes = [5, 0, 1000, 3, 16]
    drawn = sharding.communication_matrix(sizes, sharding.shard_sizes(1024, 24), rng)
    assert drawn.sum(1).tolist() == sizes and drawn.sum(0).tolist() == sharding.shard_sizes(1024, 24)


def test_permutations_are_even():
    keys = sharding.mix(np.arange(24_000, dtype=np.uint64) + np.uint64(5))
    n = np.full(24_000, 4)
    found = np.stack([sharding.permuted(np.full(24_000, i), n, keys) for i in range(4)], 1)
    counts = Counter(map(tuple, found.tolist()))
    assert set(counts) == set(itertools.permutations(range(4)))
    assert all(abs(c - 1000) < 160 for c in counts.values())
    for size in (1, 2, 3, 1000):
        moved = sharding.permuted(np.arange(size), np.full(size, size), np.full(size, 9, np.uint64))
        assert sorted(moved) == list(range(size))


def check_shards(rows, n, shards=24):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[j]) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))


def test_sharding(spark, odd, none, tmp_path):
    places = set()
    odd.write.parquet(str(tmp_path / "odd"))
    files = spark.read.parquet(str(tmp_path / "odd"))
    kept = ["doc_id", "text", "source", "lang", "n_chars", "item", "value", "pos", "leaf"]
    want = sorted(map(str, odd.select(*kept).collect()))
    for docs in (odd, files, files.filter("doc_id > 150 OR doc_id IS NULL"), files.union(files).limit(700), files.limit(10)):
        done = sharding.shuffle(docs)
        rows = done.collect()
        assert done.columns == [*kept, "shard", "slot"]
        check_shards(rows, docs.count())
        places.add(tuple((r.shard, r.slot) for r in rows))
        assert all((a.shard, a.slot) < (b.shard, b.slot) for a, b in itertools.pairwise(rows))
    again = sharding.shuffle(files).collect()
    assert sorted(map(str, sharding.shuffle(files).select(*kept).collect())) == want
    assert again == sharding.shuffle(files).collect() != sharding.shuffle(files, seed=1).collect()
    assert not sharding.shuffle(none).collect()
    rows = queries.QUERIES["op12_sharding"](spark, SF).collect()
    check_shards(rows, 200)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None
    numbers = queries.QUERIES["op12_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    assert abs(np.corrcoef(numbers.doc_id, numbers.shard)[0, 1]) < 0.15


def test_every_row_is_as_likely_in_every_shard(spark, tmp_path):
    spark.range(12).repartition(3).write.parquet(str(tmp_path / "few"))
    few, counts = spark.read.parquet(str(tmp_path / "few")), Counter()
    for seed in range(40):
        placed, n = sharding.assign(few, 3, seed)
        assert n == 12
        counts.update((r.id, r.shard) for r in placed.collect())
    assert len(counts) == 36 and all(abs(c - 40 / 3) < 13 for c in counts.values())


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """(root, the (before, after) steps of every digest)."""
    steps, below = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [digests[i : i + 16] for i in range(0, len(digests), 16)]
        for i, run in enumerate(runs):
            for k in range(len(run)):
                for leaf in below[16 * i + k]:
                    steps[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        below = [sum(below[i : i + 16], []) for i in range(0, len(below), 16)]
        digests = [h("".join(run)) for run in runs]
    return digests[0], steps


def plain_manifest(rows):
    leaf = lambda r, text: h("".join(counted(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, made = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        leaves = [leaf(r, r["text"]) for r in own]
        top, steps = tree(leaves)
        tops.append(top)
        made.append((own, leaves, steps))
    root, upper = tree(tops)
    out = []
    for top, above, (own, leaves, steps) in zip(tops, upper, made):
        for r, digest, path in zip(own, leaves, steps):
            path, text, node = path + above, r["text"], digest
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                node = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), text))
            for before, after in path:
                node = h(before + node + after)
            out.append((r["doc_id"], digest, top, root, h("".join(b + a for b, a in path)), node, node == root))
    return sorted(out, key=str)


def test_merkle_manifest(spark, odd, none):
    done = merkle.audit(odd)
    assert done.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, done.collect()), key=str)
    assert got == plain_manifest([r.asDict() for r in odd.collect()])
    assert {r[-1] for r in got} == {True, False}
    assert not merkle.audit(none).collect()
    for some in (odd.filter("lang = 'solo'"), odd.filter("lang = 'solo' OR lang = 'nothing'")):
        assert sorted(map(tuple, merkle.audit(some).collect()), key=str) == plain_manifest([r.asDict() for r in some.collect()])


def test_merkle_tree_of_three_levels_and_many_sources(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 300).cast("string"))).alias("source"),
        F.lit("en").alias("lang"), F.lit(1).alias("n_chars"),
    )
    got = sorted(map(tuple, merkle.audit(rows).collect()), key=str)
    assert got == plain_manifest([r.asDict() for r in rows.collect()])
    assert all(r[-1] == (zlib.crc32(str(r[0]).encode()) % 5 != 0) for r in got)

"""How the vocabulary of a source departs from that of its language and of its other sources.

Each task folds whole documents into a hash of stripes: a term leads to its document
frequency and to its counts by source. A full hash is spilled to the shuffle; there the
stripes of a term are merged in key order, and merged stripes emit the divergences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.workers import share
from loomset.sources.storage import stored

SCALE = 1_000_000_000
#: Bytes that the stripes of a task may hold before they are spilled, by a rough count.
SPILL_BYTES = 96 << 20
#: Texts are cut into words in parts of about this many bytes.
PART_BYTES = 1 << 20
#: Pairs of sources that are held, or compared, at a time.
PAIRS = 1 << 20
#: Groups whose totals are sent to every worker; more are joined to the stripes.
MAX_GROUPS, MAX_NAME_BYTES = 100_000, 16 << 20
#: Copies of the groups of a language in joins of its sources, so that no language is one task.
SALTS = 16

STRIPE = "lang string, term binary, df long, sources array<struct<source: string, n: long>>"
SOURCES = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
STRIPE_ARROW = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("sources", SOURCES)])
EMITTED = "lang string, source string, part string, item binary, value long"
EMITTED_ARROW = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())]
)

#: A-Z becomes a-z, other ASCII but a-z a space; bytes of longer characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a part of it at a time."""
    start = 0
    while start < len(text):
        end = start + PART_BYTES
        part = text[start:end].translate(FOLD)
        cut = len(part) if end >= len(text) else part.rfind(b" ") + 1
        while not cut:  # a term longer than a part
            end += PART_BYTES
            part = text[start:end].translate(FOLD)
            cut = len(part) if end >= len(text) else part.rfind(b" ") + 1
        yield part[:cut].split()
        start += cut


def fold(batches: Iterator[pa.RecordBatch], spill_bytes: int = SPILL_BYTES) -> Iterator[pa.RecordBatch]:
    """Stripes of (lang, source, text) rows, each row a whole document; at most one a term between spills."""
    held: dict[str, dict[bytes, list]] = {}
    size = 0
    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts.cast(pa.large_binary())):
            counts: Counter[bytes] = Counter()
            for part in words(text.as_buffer().to_pybytes()):
                counts.update(part)
            stripes = held.setdefault(lang, {})
            for term, n in counts.items():
                stripe = stripes.get(term)
                if stripe is None:
                    stripes[term] = [1, {source: n}]
                    size += 400 + len(term)
                else:
                    stripe[0] += 1
                    own = stripe[1]
                    if source in own:
                        own[source] += n
                    else:
                        own[source] = n
                        size += 60
            if size > spill_bytes:
                yield from spilled(held)
                held, size = {}, 0
    yield from spilled(held)


def spilled(held: dict[str, dict[bytes, list]], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of folded stripes."""
    for lang, stripes in held.items():
        terms = list(stripes)
        for at in range(0, len(terms), rows):
            some = terms[at : at + rows]
            found = [stripes[t] for t in some]
            ends = np.cumsum([0] + [len(s[1]) for s in found]).astype(np.int32)
            names = pa.array([x for s in found for x in s[1]], pa.string())
            counts = pa.array([x for s in found for x in s[1].values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()),
                    pa.array([s[0] for s in found], pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([names, counts], ["source", "n"])),
                ],
                schema=STRIPE_ARROW,
            )


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each value, values by code)."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(place of each element's list, the elements)."""
    lengths = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def merge_equal(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One stripe for each run of rows with the same language and term."""
    lang, term = rows.column(0), rows.column(1)
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        differ = pa.compute.or_(
            pa.compute.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)),
            pa.compute.not_equal(term.slice(1), term.slice(0, len(term) - 1)),
        )
        new[1:] = differ.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    if len(first) == rows.num_rows:
        return rows
    run = np.cumsum(new) - 1
    at, elements = flat(rows.column(3))
    code, names = codes(elements.field(0))
    keys, totals = summed(run[at] * len(names) + code, elements.field(1).to_numpy())
    ends = np.searchsorted(keys, np.arange(len(first) + 1) * len(names)).astype(np.int32)
    merged = pa.StructArray.from_arrays([names.take(pa.array(keys % len(names))), pa.array(totals)], ["source", "n"])
    df = np.add.reduceat(rows.column(2).to_numpy(), first)
    of = pa.array(first)
    return pa.RecordBatch.from_arrays(
        [lang.take(of), term.take(of), pa.array(df), pa.ListArray.from_arrays(ends, merged)], schema=STRIPE_ARROW
    )


def merge(least: int):
    """A function that merges stripes in key order and keeps terms of at least ``least`` documents.

    It holds one batch and one merged stripe, however many spills a term has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.cast(STRIPE_ARROW)
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            done = merge_equal(batch)
            carry = done.slice(done.num_rows - 1)
            done = done.slice(0, done.num_rows - 1)
            yield done.filter(pa.compute.greater_equal(done.column(2), least))
        if carry is not None:
            yield carry.filter(pa.compute.greater_equal(carry.column(2), least))

    return run


def scaled(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * part / whole)``, exact by long division for wholes below nine million milliards."""
    whole = np.broadcast_to(whole, part.shape)
    found, rest = part // whole, part % whole
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return 1 + found


def departure(p, q):
    """``floor((p - q)^2 / q)``."""
    return (p - q) * (p - q) // q


def scaled_column(part: Column, whole: Column) -> Column:
    """The same as ``scaled`` for columns; null where the whole is 0."""
    product = F.lit(SCALE).cast("decimal(10,0)") * part.cast("decimal(20,0)")
    return F.call_function("div", product, F.nullif(whole, F.lit(0)).cast("decimal(20,0)")) + F.lit(1)


def departure_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pairs_within(at: np.ndarray, limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all two different elements of one list, ``at`` being their lists in order, some pairs at a time."""
    if not len(at):
        return
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    lengths = np.diff(np.append(starts, len(at)))
    own_start, own_length = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    made = np.cumsum(own_length)
    begin = 0
    while begin < len(at):
        before = made[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(made, before + limit, side="right")))
        n = own_length[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = np.repeat(own_start[begin:end], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        differ = i != j
        yield i[differ], j[differ]
        begin = end


class PairSums:
    """Sums by ordered pair of (language, source); full ones are given away."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, str], int] = {}
        self.groups: list[tuple[str, str]] = []
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, groups: list[tuple[str, str]]) -> np.ndarray:
        for g in groups:
            if g not in self.number:
                self.number[g] = len(self.groups)
                self.groups.append(g)
        return np.array([self.number[g] for g in groups], np.int64)

    def add(self, left: np.ndarray, right: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, sums = summed((left << 31) | right, values)
        self.keys, self.sums = summed(np.concatenate((self.keys, keys)), np.concatenate((self.sums, sums)))
        if len(self.keys) > PAIRS:
            yield from self.take()

    def take(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.keys), 50_000):
            left, right = self.keys[at : at + 50_000] >> 31, self.keys[at : at + 50_000] & ((1 << 31) - 1)
            left, right = [self.groups[k] for k in left], [self.groups[k] for k in right]
            yield emitted([x[0] for x in left], [x[1] for x in left], "pair", [x[1].encode() for x in right], self.sums[at : at + 50_000])
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)


def emitted(langs, sources, part: str, items, values) -> pa.RecordBatch:
    arrays = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array([part] * len(values), pa.string())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(items, pa.binary()), pa.array(values, pa.int64())], schema=EMITTED_ARROW)


def emit(totals):
    """A function that turns merged stripes into divergences.

    It emits the departure of each source's share of a term from the language's, where it
    is larger, and for two sources that both have terms what those terms add to their
    divergence beyond the part that ``without_terms`` and ``against_missing`` count for
    sources without them. ``totals`` gives {(lang, source): tokens} and {lang: (terms, tokens)};
    where it is None the rows carry them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_group, of_lang = totals() if totals else (None, None)
        pairs = PairSums()
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, terms, lists = batch.column("lang"), batch.column("term").cast(pa.binary()), batch.column("sources")
            at, elements = flat(lists)
            lang_code, lang_names = codes(langs)
            code, names = codes(elements.field(0))
            n = elements.field(1).to_numpy()
            groups, of = np.unique(lang_code[at] * len(names) + code, return_inverse=True)
            lang_list, name_list = lang_names.to_pylist(), names.to_pylist()
            keys = [(lang_list[g // len(names)], name_list[g % len(names)]) for g in groups.tolist()]
            if totals:
                tokens = np.array([of_group[k] for k in keys], np.int64)[of]
                kept, lang_tokens = np.array([of_lang[x] for x in lang_list], np.int64)[lang_code].T
            else:
                tokens = elements.field(2).to_numpy()
                kept, lang_tokens = batch.column("terms").to_numpy(), batch.column("tokens").to_numpy()
            p, none = scaled(n + 1, tokens + kept[at]), scaled(np.ones_like(n), tokens + kept[at])
            counts = np.bincount(at, minlength=batch.num_rows).astype(np.int64)
            in_lang = np.add.reduceat(n, np.cumsum(counts) - counts)
            q = scaled(in_lang + 1, lang_tokens + kept)[at]
            more = np.flatnonzero(p > q)
            group_lang, group_name = pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])
            of_more = pa.array(of[more])
            yield emitted(group_lang.take(of_more), group_name.take(of_more), "term",
                          terms.take(pa.array(at[more])), departure(p[more], q[more]))
            number = pairs.numbers(keys)[of]
            for i, j in pairs_within(at):
                value = departure(p[i], p[j]) - departure(p[i], none[j]) - departure(none[i], p[j]) + departure(none[i], none[j])
                yield from pairs.add(number[i], number[j], value)
        yield from pairs.take()

    return run


def stripes(docs: DataFrame, least_docs: int = 3, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, df, sources) of the terms that at least ``least_docs`` documents of a language have, written.

    Every row is a document of its own, also one that repeats another. Null texts,
    languages and sources are empty ones; a text without terms has no stripe.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
                         ((lang, "lang"), (source, "source"), (text, "text"))])
    folded = rows.mapInArrow(fold, STRIPE)
    dealt = folded.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return stored(dealt.mapInArrow(merge(least_docs), STRIPE), "stripes")


def group_totals(docs: DataFrame, merged: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, n, terms, tokens, none) of every group, written.

    ``n`` is its occurrences of kept terms, ``terms`` and ``tokens`` what its language has
    of kept terms and of their occurrences, ``none`` the scaled share of a term that it lacks.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
                           ((lang, "lang"), (source, "source"))]).distinct()
    own = merged.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    own = groups.join(own, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    own = stored(own, "group-counts")
    whole = merged.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    whole = own.groupBy("lang").agg(F.sum("n").alias("tokens")).join(whole, "lang", "left")
    joined = own.join(whole, "lang").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long")))
    none = scaled_column(F.lit(1), F.col("n") + F.col("terms"))
    return stored(joined.select("lang", "source", "n", "terms", "tokens", none.alias("none")), "groups")


def salted(groups: DataFrame) -> DataFrame:
    """The groups as partners ``item`` in a join by language and salt."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), copies)


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def without_terms(groups: DataFrame) -> DataFrame:
    """The divergence of every two sources of a language as if both lacked every kept term."""
    pairs = groups.select("*", salt("source")).join(salted(groups), ["lang", "salt"]).filter("source <> item")
    value = F.coalesce(F.col("terms") * departure_column(F.col("none"), F.col("item_none")), F.lit(0).cast("long"))
    return pairs.select("lang", "source", "item", value.alias("value"))


def against_missing(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """What the terms of one source add to its pairs with sources that lack them, both ways.

    Terms that a source has equally often add the same, so a histogram of its counts meets
    the other sources and not its terms.
    """
    histogram = merged.select("lang", F.inline("sources")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    own = groups.select("lang", "source", F.col("n").alias("all"), "terms", "none")
    share = scaled_column(F.col("n") + 1, F.col("all") + F.col("terms"))
    rows = histogram.join(own, ["lang", "source"]).select("lang", "source", "times", "none", share.alias("p"), salt("source", "n"))
    pairs = rows.join(salted(groups), ["lang", "salt"]).filter("source <> item")
    p, none, other = F.col("p"), F.col("none"), F.col("item_none")
    there = F.col("times") * (departure_column(p, other) - departure_column(none, other))
    back = F.col("times") * (departure_column(other, p) - departure_column(other, none))
    ways = F.array(
        F.struct(F.col("source"), F.col("item"), there.alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value")),
    )
    return pairs.select("lang", F.inline(ways))


def totals_for_workers(groups: DataFrame):
    """The totals of all groups as a function for tasks, or None if they are too many to send."""
    size = F.sum(F.octet_length("lang") + F.octet_length("source"))
    n, names = groups.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if n > MAX_GROUPS or names > MAX_NAME_BYTES:
        return None
    rows = groups.select("lang", "source", "n", "terms", "tokens").collect()
    return share(groups.sparkSession, ({(r[0], r[1]): r[2] for r in rows}, {r[0]: (r[3], r[4]) for r in rows}))


def with_totals(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """Stripes with the totals of their groups in their rows; a stripe has one element a source."""
    rows = merged.select("lang", "term", F.inline("sources"))
    rows = rows.join(groups.select("lang", "source", F.col("n").alias("all"), "terms", "tokens"), ["lang", "source"])
    elements = F.collect_list(F.struct("source", "n", "all")).alias("sources")
    return rows.groupBy("lang", "term").agg(F.first("terms").alias("terms"), F.first("tokens").alias("tokens"), elements)


def audit(
    docs: DataFrame, least_docs: int = 3, top_terms: int = 200, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergences of every (language, source) group of ``docs``.

    Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case. Of
    a language, those in at least ``least_docs`` documents are kept. A group's share of a term
    is ``1 + floor(10^9 (count + 1) / (tokens + terms))`` over the kept ones. Part ``pair`` has
    for every other source of the language the sum of ``floor((p - q)^2 / q)`` over all
    kept terms, q being that source's shares; part ``term`` has the ``top_terms`` terms of the
    group whose share exceeds most that of the language. Ranks start at 1, ties go
    to the smaller item in UTF-8.

    Null texts, languages and sources are empty ones; groups without terms have pairs
    too, of value 0 if the language keeps no term. Repeated rows are documents each. An empty
    table gives an empty result, and other columns are not read.

    Of a pair of sources, only terms that both have are visited together; terms that one or
    both lack are counted from histograms. All numbers are whole and exact.
    """
    merged = stripes(docs, least_docs, lang, source, text)
    groups = group_totals(docs, merged, lang, source)
    totals = totals_for_workers(groups)
    rows = merged.select("lang", "term", "sources") if totals else with_totals(merged, groups)
    out = stored(rows.mapInArrow(emit(totals), EMITTED), "divergences")
    out = out.withColumn("item", F.col("item").cast("string"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = out.filter("part = 'term'").select("*", rank).filter(F.col("rank") <= top_terms)
    exact = lambda df: df.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    pairs = exact(without_terms(groups)).union(exact(against_missing(merged, groups)))
    pairs = pairs.union(exact(out.filter("part = 'pair'"))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"))
    return pairs.select("*", rank).union(terms)

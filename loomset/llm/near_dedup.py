"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Exact copies are one text. Every distinct text gets weighted samples whose agreement
has the probability of the weighted Jaccard similarity; bands of samples propose
candidates, and the weighted Jaccard similarity of the whole texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm.components import components
from loomset.llm.shingles import ID_BITS, ODD, counted, mix, shingle_keys, slices
from loomset.llm.workers import share
from loomset.plans.tree import sum_vectors
from loomset.sources.storage import stored

SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Document shares: from HEAVY on a shingle's frequency lowers its weight, the more so
#: above PRIOR. Texts of d shingles on average have at most d / HEAVY such shingles.
HEAVY = 0.01
PRIOR = 0.5
#: Sections, by shingle id, whose weights bound what two texts share.
SECTIONS = 32
#: Shingles counted at a time while frequent ones are sought.
CHUNK = 2_000_000
#: Texts that partitions hold at least, on average, while shingles are counted.
CHUNK_TEXTS = 2_000
#: Counters of a row for each byte of the mean text. A text has at most a shingle for two
#: bytes, so a counter holds less than a HEAVY share from rare shingles, on average.
COUNTERS = 64
#: Counters that are added up together.
STRIPE = 1 << 14


class Weights:
    """Inverse document frequency ``ln(1 + N / (df + PRIOR N))`` of shingle ids.

    Shingles below the HEAVY share count as having no frequency, which changes their
    weight by less than two hundredths; only the others are kept, sorted by id.
    """

    def __init__(self, ids: np.ndarray, docs: np.ndarray, n: int):
        order = np.argsort(ids)
        self.ids, self.n = ids[order], max(n, 1)
        self.values = np.log1p(self.n / (docs[order] + PRIOR * self.n))
        self.rare = float(np.log1p(1 / PRIOR))

    def of(self, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Weight of each shingle: its times in the text by its inverse frequency."""
        idf = np.full(len(ids), self.rare)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            idf = np.where(self.ids[at] == ids, self.values[at], self.rare)
        return times * idf


def frequent_shingles(docs: DataFrame, text: str) -> Weights:
    """Count over all documents, exactly, the shingles in a HEAVY share of them or more.

    Each task adds up its shingles in two rows of counters, whose number follows from the
    mean length of a text, not from the corpus or from how copies lie together. A shingle
    is as frequent as that only if both its counters are; a second pass counts those
    exactly. Small partitions are read together, so that counters stay few against texts.
    """
    rows = docs.select(F.col(text).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    texts = rows.coalesce(max(1, -(-n // CHUNK_TEXTS)))
    half = int(ID_BITS) // 2
    bits = min(max((COUNTERS * size // max(n, 1)).bit_length(), STRIPE.bit_length() - 1), half)

    def places(ids: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(2):
            yield ((ids >> np.uint64(k * half)) & np.uint64((1 << bits) - 1)).astype(np.int64) + (k << bits)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        parts, held = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                parts.append(counted(shingle_keys(piece.column("text")))[1])
                held += len(parts[-1])
                if held > CHUNK:
                    yield np.concatenate(parts)
                    parts, held = [], 0
        if held:
            yield np.concatenate(parts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << bits, np.int64)
        for ids in chunks(batches):
            for place in places(ids):
                total += np.bincount(place, minlength=len(total))
        if total.any():
            for k, docs in enumerate(total.reshape(-1, STRIPE)):
                one = pa.ListArray.from_arrays(pa.array([0, STRIPE], pa.int32()), pa.array(docs))
                yield pa.RecordBatch.from_pydict({"stripe": pa.array([k], pa.int32()), "docs": one})

    sums = sum_vectors(texts.mapInArrow(tally, "stripe int, docs array<long>"), "docs", ["stripe"])
    full = sums.select("stripe", F.posexplode("docs").alias("at", "docs")).filter(F.col("docs") >= HEAVY * n)
    full = [r[0] for r in full.select(F.col("stripe") * STRIPE + F.col("at")).collect()]
    if not full:
        return Weights(np.zeros(0, np.uint64), np.zeros(0), n)
    flags = np.zeros(2 << bits, bool)
    flags[full] = True
    get = share(docs.sparkSession, flags)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in chunks(batches):
            likely = np.logical_and(*[get()[place] for place in places(ids)])
            found, docs = np.unique(ids[likely], return_counts=True)
            yield pa.RecordBatch.from_pydict({"id": pa.array(found.astype(np.int64)), "docs": pa.array(docs)})

    counts = texts.mapInArrow(exact, "id long, docs long").groupBy("id").agg(F.sum("docs").alias("docs"))
    rows = counts.filter(F.col("docs") >= HEAVY * n).collect()
    return Weights(np.array([r.id for r in rows], np.uint64), np.array([r.docs for r in rows], float), n)


def gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, at the middles of ``size`` equal steps."""
    want = (np.arange(size) + 0.5) / size
    x = np.full(size, 1.0)
    for _ in range(80):  # Newton steps on ln x, from the tail probability (1 + x) exp(-x)
        x = x * np.exp(np.clip((want - 1 + (1 + x) * np.exp(-x)) / (x * x * np.exp(-x) + 1e-300), -0.5, 0.5))
    return x


def samples(row: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and sample, a hash of the chosen (shingle, level): rows that have shingles, values.

    One mixed word per shingle and sample gives the two gamma values and the uniform
    one. Equal values of the smallest key are settled by the smaller id.
    """
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    lengths = np.diff(np.append(starts, len(row)))
    rates = gamma_table()
    inverse, logs = (1 / rates).astype(np.float32), np.log(rates).astype(np.float32)
    rates = rates.astype(np.float32)
    log_w = np.log(weights).astype(np.float32)
    out = np.zeros((len(starts), n), np.uint64)
    low = np.uint64(0xFFFF)
    for k in range(n):
        h = mix(ids + mix(np.full(1, k + 1, np.uint64) * ODD))
        at = (h & low).astype(np.intp)
        r, beta = rates[at], ((h >> np.uint64(32)) & low).astype(np.float32) / np.float32(65536)
        level = np.floor(log_w * inverse[at] + beta)
        key = logs[((h >> np.uint64(16)) & low).astype(np.intp)] - r * (level - beta) - r
        best = np.repeat(np.minimum.reduceat(key, starts), lengths)
        hit = np.flatnonzero(key == best)
        first = hit[np.concatenate(([True], row[hit][1:] != row[hit][:-1]))]
        out[:, k] = mix(ids[first] * np.uint64(3) + level[first].astype(np.int64).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return row[starts], out


def sketch(docs: DataFrame, text: str, weights: Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The columns of ``docs``, its text replaced by the hashes of its bands (none without words)."""
    kept = [c for c in docs.columns if c != text]
    get = share(docs.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                row, ids, times = counted(shingle_keys(piece.column(text)))
                ends = np.zeros(piece.num_rows + 1, np.int32)
                flat = np.zeros(0, np.int64)
                if len(row):
                    has, drawn = samples(row, ids, get().of(ids, times), bands * rows)
                    folded = np.zeros((len(has), bands), np.uint64)
                    for k in range(rows):
                        folded = mix(folded + drawn[:, k::rows] + np.uint64(k))
                    folded = mix(folded + np.arange(bands, dtype=np.uint64))
                    ends[has + 1] = bands
                    flat = folded.reshape(-1).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], lists], names=[*kept, "bands"])

    schema = docs.select(*kept).schema.add("bands", T.ArrayType(T.LongType()))
    return docs.mapInArrow(run, schema)


def similarity(pairs: DataFrame, left: str, right: str, weights: Weights) -> DataFrame:
    """``pairs`` with the two texts replaced by their weighted Jaccard ``similarity``."""
    kept = [c for c in pairs.columns if c not in (left, right)]
    get = share(pairs.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, left, right):
                sides = [counted(shingle_keys(piece.column(c))) for c in (left, right)]
                row, ids, times = (np.concatenate(x) for x in zip(*sides, strict=True))
                w = get().of(ids, times)
                order = np.lexsort((ids, row))
                row, ids, w = row[order], ids[order], w[order]
                twin = np.flatnonzero((row[1:] == row[:-1]) & (ids[1:] == ids[:-1]))
                n = piece.num_rows
                both = np.bincount(row[twin], np.minimum(w[twin], w[twin + 1]), n)
                all_ = np.bincount(row, w, n) - both
                value = np.divide(both, all_, out=np.zeros(n), where=all_ > 0)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(value)], names=[*kept, "similarity"])

    return pairs.mapInArrow(run, pairs.select(*kept).schema.add("similarity", "double"))


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the member of each bucket that meets most others, against the bucket's other members.

    ``members`` has (bucket, text, n): a bucket's texts and their number. The original of
    a group of edited copies is closer to each of them than they are to one another, so
    it shares the most buckets and is the hub that joins them.
    """
    met = members.groupBy("text").agg(F.sum("n").alias("met"))
    ranked = members.join(met, "text")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("met", "text"))["text"].alias("hub"))
    pairs = members.join(hubs, "bucket").filter("hub <> text")
    return pairs.select(F.least("hub", "text").alias("a"), F.greatest("hub", "text").alias("b")).distinct()


def shared_weights(bodies: DataFrame, weights: Weights, sections: int = SECTIONS) -> DataFrame:
    """(key, total, shared, parts): a text's weight, that of its shingles which other components have too.

    ``parts`` splits ``shared`` by section: an array of the weight in each, by shingle id.
    ``bodies`` has (key, text, part), the hash of the text's component.
    """
    get = share(bodies.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                row, ids, times = counted(shingle_keys(piece.column("text")))
                own = [piece.column(c).take(pa.array(row)) for c in ("key", "part")]
                columns = [*own, pa.array(ids.astype(np.int64)), pa.array(get().of(ids, times))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "id", "w"])

    schema = bodies.select("key", "part").schema.add("id", T.LongType()).add("w", T.DoubleType())
    every = stored(bodies.select("key", "text", "part").mapInArrow(run, schema), "shingles")
    more = every.groupBy("id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    more = more.filter("a < b").select("id", F.lit(True).alias("more"))
    both = every.join(more, "id", "left").withColumn("met", F.when(F.col("more"), F.col("w")).otherwise(0.0))
    section = F.col("id") % sections
    parts = F.array(*[F.sum(F.when(section == k, F.col("met")).otherwise(0.0)).cast("float") for k in range(sections)])
    return both.groupBy("key").agg(F.sum("w").alias("total"), F.sum("met").alias("shared"), parts.alias("parts"))


def open_pairs(members: DataFrame, names: DataFrame, bodies: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(a, b): texts of a bucket that may be similar and are in different components.

    Texts known to be of one component need no comparison, so one of a pair is outside
    the bucket's largest component. What two texts share is at most the lesser of their
    weights in shingles that other components have too, summed by sections of such
    shingles. This bounds their similarity: most edited copies of one original lack
    shingles in different sections, and cannot be similar to each other.
    """
    known = members.join(names.withColumnRenamed("node", "text"), "text", "left")
    known = known.select("bucket", "text", F.coalesce("component", "text").alias("component"))
    sizes = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    known = stored(known.join(top.filter("parts > 1").select("bucket", F.col("top.component").alias("main")), "bucket"), "open")
    parts = known.select(F.col("text").alias("key"), F.xxhash64("component").alias("part")).distinct()
    texts = bodies.join(parts, "key")
    sums = shared_weights(texts, weights).filter(F.col("shared") >= (least - 1e-9) * F.col("total"))
    known = stored(known.join(sums.withColumnRenamed("key", "text"), "text"), "open")
    rest = known.filter("component <> main").select(
        "bucket", F.col("text").alias("a"), F.col("component").alias("of"),
        F.col("total").alias("t"), F.col("shared").alias("s"), F.col("parts").alias("p"),
    )
    #: The sections are floats; the margin is above their rounding, so no pair is ruled out by it.
    needed = (least - 1e-5) * (known["total"] + rest["t"])
    whole = (1 + least) * F.least(known["shared"], rest["s"]) >= needed
    lesser = F.zip_with(known["parts"], rest["p"], lambda x, y: F.least(x, y))
    by_parts = (1 + least) * F.aggregate(lesser, F.lit(0.0), lambda x, y: x + y) >= needed
    met = known.join(rest, (known["bucket"] == rest["bucket"]) & (known["component"] != rest["of"]) & whole & by_parts)
    return met.select(F.least("a", "text").alias("a"), F.greatest("a", "text").alias("b")).distinct()


def links(texts: DataFrame, sketches: DataFrame, weights: Weights, least: float = SIMILARITY) -> DataFrame:
    """(a, b) of candidate texts at least ``least`` similar, enough to join all that are.

    ``texts`` has (text key ``key``, ``text``), ``sketches`` (``key``, ``bands``), a row per text.
    In each bucket a hub is compared with all others, and then the texts outside the
    bucket's largest component with those of other components. So no link between
    components is lost, and a group of near copies does not make all its pairs.
    """
    placed = sketches.select(F.col("key").alias("text"), F.posexplode("bands").alias("band", "value"))
    placed = placed.select(F.xxhash64("band", "value").alias("bucket"), "text")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(placed.join(shared, "bucket"), "buckets")
    wanted = members.select(F.col("text").alias("key")).distinct()
    bodies = stored(texts.join(wanted, "key", "left_semi").dropDuplicates(["key"]), "candidate-texts")

    def judged(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda x: bodies.select(F.col("key").alias(x), F.col("text").alias(f"{x}_text"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return stored(similarity(both, "a_text", "b_text", weights), name)

    first = judged(hub_pairs(members), "judged")
    found = first.filter(F.col("similarity") >= least).select("a", "b")
    names = stored(components(found), "names")
    second = open_pairs(members, names, bodies, weights, least).join(first.select("a", "b"), ["a", "b"], "left_anti")
    return found.union(judged(stored(second, "pairs"), "judged").filter(F.col("similarity") >= least).select("a", "b"))


def text_key(text: Column) -> Column:
    """A 128-bit key of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("b")).alias("b"))


def named_texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((id, key, bands) of every row, (key, class_id, n_links, is_first) of every text that has words).

    Of a class, the text with the smallest id, and then the smallest text key, is its first.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    keyed = rows.withColumn("key", text_key(F.col("text")))
    weights = frequent_shingles(rows, "text")
    every = stored(sketch(keyed, "text", weights), "sketches")
    full = every.filter(F.size("bands") > 0)
    texts = full.groupBy("key").agg(F.min("id").alias("first"), F.first("bands").alias("bands"))
    texts = stored(texts, "texts")
    edges = stored(links(keyed.select("key", "text"), texts, weights), "links")
    names = stored(components(edges), "names").withColumnRenamed("node", "key")
    ends = edges.select(F.explode(F.array("a", "b")).alias("key"))
    degrees = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    linked = texts.select("key", "first").join(names, "key").join(degrees, "key")
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("least")
    least = linked.groupBy("component").agg(least).select("component", "least.first", F.col("least.key").alias("own"))
    found = linked.select("key", "component", "n_links").join(least, "component")
    found = stored(found.select("key", F.col("first").alias("class_id"), "n_links", (F.col("key") == F.col("own")).alias("is_first")), "linked")
    alone = texts.select("key", "first").join(found, "key", "left")
    alone = alone.select(
        "key", F.when(F.col("is_first").isNull(), F.col("first")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("is_first", F.lit(True)).alias("is_first"),
    )
    return every, alone


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, class_id, n_links), one row per document.

    A class is named by the smallest key in it; ``n_links`` counts the verified links of
    the document's text to other texts, enough to join the class. Copies are in one class. Null texts and texts
    without words are like nothing: each is a class of its own, named by its own key.
    Repeated rows give a row each, a null key stays null; other columns are not used.
    """
    every, named = named_texts(docs, key, text)
    full = every.filter(F.size("bands") > 0)
    out = full.select("id", "key").join(named, "key").select("id", "class_id", "n_links")
    empty = every.filter(F.size("bands") == 0).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(empty).withColumnRenamed("id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: of its first text, the one with the smallest key.

    A key may repeat: rows are told apart by key and text, and of rows that share both, the one with the
    smallest hash of all its columns stays. Rows without words stay, as they are like nothing. Rows
    with a null key cannot be named and stay.
    """
    _, named = named_texts(docs, key, text)
    first = named.filter("is_first").select(F.col("key").alias("_key"), F.col("class_id").alias("_id"))
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(F.col(key).isNotNull()).select(F.struct("*").alias("_row"), has_words.alias("_words"), text_key(F.col(text)).alias("_key"))
    rows = rows.withColumn("_id", F.col("_row")[key])
    kept = rows.filter("_words").join(first, ["_key", "_id"], "left_semi").unionByName(rows.filter("NOT _words").select("_row", "_words", "_key", "_id"))
    one = kept.groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return one.select("_row.*").select(*docs.columns).union(docs.filter(F.col(key).isNull()))

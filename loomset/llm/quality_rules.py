"""Quality rules with cross-document line frequency, in DataFrame functions only.

A verdict depends on the text and its host alone, so it is computed once per
(host, text) and joined back by their hash; copies of a text share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.binding import let
from loomset.llm import near_copies
from loomset.sources.storage import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS_ONLY = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is removed when it stands in more distinct texts of a host, whatever the size of the host.
MAX_LINE_DOCS = 20
#: A document that loses more than this share of its words is depleted.
MAX_REMOVED_SHARE = 0.75
#: Where near copies are folded, texts with this share of their words in frequent lines are compared.
#: Others lose so little that a later comparison still sees them as copies.
LEAST_FOLDED_SHARE = 0.2


def split_words(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space. Null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more in the text."""

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def places(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def place(x: Column, j: Column) -> Column:
                before, after = F.get(s, j - 1)["h"], F.get(s, j + 1)["h"]
                same = F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))
                return F.when(same, x["i"])

            return F.sort_array(F.array_compact(F.transform(s, place)))

        return let(pairs, twice)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda v, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - v, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(found: Column) -> Column:
        clean = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(clean, F.lit(0)).otherwise(let(places(found), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), count)))


def line_hashes(text: Column) -> Column:
    """Per line that has a word: the hash of its normal form and its number of words.

    Case, runs of white space and the digits of numbers make no difference.
    """
    normal = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    lines = F.transform(F.split(F.regexp_replace(normal, "[0-9]+", "0"), "\n"), lambda x: F.trim(x))
    gaps = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    entry = lambda x: F.struct(F.xxhash64(x).alias("line"), (gaps(x) + 1).alias("words"))
    return F.transform(F.filter(lines, lambda x: x != ""), entry)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def text_key(text: Column) -> Column:
    """A 128-bit key of a text; null and empty texts have the same one."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("b")).alias("b"))


def base_statistics(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``row``, the columns of ``docs`` but ``text``, and ``stats``: counts, text key and lines.

    A null text counts as an empty one. ``stats`` holds n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, key and lines.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(whole, SYMBOLS_ONLY, "")).cast("long").alias("n_symbols"),
            duplicate_lines(whole).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            text_key(F.col(text)).alias("key"),
            line_hashes(whole).alias("lines"),
        )

    kept = F.struct(F.col(host), *[F.col(c) for c in docs.columns if c not in (text, host)])
    done = docs.select(kept.alias("row"), let(split_words(F.col(text)), counts).alias("stats"))
    n, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    return done.withColumn("stats", F.col("stats").withField("base_failed", failed))


def frequent_lines(base: DataFrame, host: str, max_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """(host, line) of lines that stand in more than ``max_docs`` distinct texts of a host.

    Exact copies of a text count once per host, so that a group of copies does not
    make its own lines frequent. The first shuffle goes by host, line and text: a line
    that stands everywhere is spread over all tasks, and the second one carries counts.
    """
    where = F.coalesce(F.col(f"row.{host}"), F.lit("")).alias("host")
    texts = base.select(where, F.col("stats.key").alias("key"), F.array_distinct(F.col("stats.lines.line")).alias("at"))
    seen = texts.select("host", "key", F.explode("at").alias("line")).distinct()
    counted = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.filter(F.col("n_docs") > max_docs).select("host", "line")


def without_copied_lines(
    frequent: DataFrame, base: DataFrame, docs: DataFrame, text: str, host: str, max_docs: int = MAX_LINE_DOCS
) -> DataFrame:
    """The ``frequent`` lines that are so too when near copies of a text count once in a host.

    Only texts with a LEAST_FOLDED_SHARE of their words in frequent lines are compared:
    a large group of near copies makes most of its own lines frequent.
    """
    where = lambda x: F.coalesce(x, F.lit("")).alias("host")
    texts = base.select(where(F.col(f"row.{host}")), F.col("stats.key").alias("key"), "stats.n_words", "stats.lines")
    lines = texts.dropDuplicates(["host", "key"]).select("host", "key", "n_words", F.inline("lines"))
    hits = stored(lines.join(frequent, ["host", "line"]), "frequent-places")
    sums = hits.groupBy("host", "key").agg(F.sum("words").alias("lost"), F.first("n_words").alias("n_words"))
    heavy = sums.filter(F.col("lost") >= LEAST_FOLDED_SHARE * F.col("n_words")).select("host", "key")
    bodies = docs.select(where(F.col(host)), text_key(F.col(text)).alias("key"), F.col(text).alias("body"))
    bodies = bodies.join(heavy, ["host", "key"], "left_semi")
    of = F.struct("host", "key")
    sketches = bodies.select("host", of.alias("text"), near_copies.sketch(split_words(F.col("body"))).alias("sketch"))
    names = near_copies.groups(stored(sketches.dropDuplicates(["text"]), "sketches"))
    named = hits.withColumn("node", of).join(names, "node", "left")
    named = named.select("host", "line", F.coalesce("component", "node").alias("copies")).distinct()
    counted = named.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.filter(F.col("n_docs") > max_docs).select("host", "line")


def removed_lines(base: DataFrame, host: str, frequent: DataFrame) -> DataFrame:
    """Per (host, key) that has frequent lines: their hashes and the words in them.

    The frequent lines are unique, so a line of many texts is a skewed key of one side
    only, which Spark can split.
    """
    where = F.coalesce(F.col(f"row.{host}"), F.lit("")).alias("host")
    texts = base.select(where, F.col("stats.key").alias("key"), F.col("stats.lines").alias("lines"))
    lines = texts.dropDuplicates(["host", "key"]).select("host", "key", F.inline("lines"))
    return (
        lines.join(frequent.select("host", "line"), ["host", "line"])
        .groupBy("host", "key")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", fold: bool = False, **limits) -> DataFrame:
    """One row per document: the columns of ``docs`` but ``text``, its counts and verdict.

    Adds a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_words (in lines above the limits), kept, key
    and the hashes of the removed lines; a column of that name is replaced. A null host is a host of its own; null and
    empty texts fail the base rules; repeated rows get the same verdict each; an empty
    table gives an empty one. ``fold`` counts near copies once in line frequencies, too.
    """
    base = stored(base_statistics(docs, text, host), "quality-base")
    frequent = stored(frequent_lines(base, host, **limits), "frequent-lines")
    if fold:
        frequent = stored(without_copied_lines(frequent, base, docs, text, host, **limits), "frequent-lines")
    removed = removed_lines(base, host, frequent).select(F.struct("host", "key").alias("of"), "removed_words", "removed")
    mine = F.struct(F.coalesce(F.col(f"row.{host}"), F.lit("")).alias("host"), F.col("stats.key").alias("key"))
    lost = F.coalesce(F.col("removed_words"), F.lit(0))
    kept = ~F.col("stats.base_failed") & (lost <= MAX_REMOVED_SHARE * F.col("stats.n_words"))
    verdict = F.col("stats").dropFields("lines")
    verdict = verdict.withField("removed_words", lost).withField("kept", kept).withField("removed", F.col("removed"))
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text, "quality")]
    return base.withColumn("of", mine).join(removed, "of", "left").select(*rest, verdict.alias("quality"))


def clean(
    docs: DataFrame, text: str = "text", host: str = "source", length: str | None = "n_chars", fold: bool = False, **limits
) -> DataFrame:
    """The documents that pass, without the lines above the limits; the columns stay.

    Near copies count once in line frequencies with ``fold``. ``length``, if the table has it, is set to the new number of characters. The join
    carries one verdict per host and text, whatever the number of copies.
    """
    verdicts = judge(docs.select(text, host), text, host, fold, **limits).filter("quality.kept")
    found = verdicts.select(
        F.struct(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col("quality.key").alias("key")).alias("of"),
        F.col("quality.removed").alias("removed"),
    ).dropDuplicates(["of"])
    mine = F.struct(F.coalesce(F.col(host), F.lit("")).alias("host"), text_key(F.col(text)).alias("key"))
    rows = docs.select(F.struct("*").alias("row"), mine.alias("of")).join(found, "of")
    normal = lambda x: F.trim(
        F.regexp_replace(F.lower(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " ")), "[0-9]+", "0")
    )
    stays = lambda x: ~F.array_contains(F.col("removed"), F.xxhash64(normal(x)))
    cut = F.array_join(F.filter(F.split(F.col(f"row.{text}"), "\n"), stays), "\n")
    out = rows.select(F.struct("row.*").alias("row"), F.when(F.col("removed").isNull(), F.col(f"row.{text}")).otherwise(cut).alias("cut"))
    new = {text: F.col("cut")}
    if length in docs.columns:
        new[length] = F.length("cut").cast(docs.schema[length].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

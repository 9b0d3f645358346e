"""CSV with line breaks in quoted fields, read by many tasks a file.

Whether a line break ends a record depends on the number of quotes before it in the whole
file. The lines of each split are therefore counted first: the parity of the
quotes in all earlier splits tells whether a split begins inside a field. Then each
split puts its lines together to records on its own, and only the pieces of records that
cross a border, two a split at most, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomset.plans.sizes import broadcast_if
from loomset.sources.storage import stored

RECORD, HEAD, MIDDLE, TAIL = range(4)
#: Splits that begin inside a field and may be broadcast, a path and an offset each.
MAX_OPEN_SPLITS = 200_000
PIECES = "file STRING, start BIGINT, kind INT, is_first BOOLEAN, text STRING"
PIECES_ARROW = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("is_first", pa.bool_()), ("text", pa.large_string())]
)


def _count(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(text, file, start, quotes)``: the lines in order, with their split and their quotes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    place = lines.metadataColumn("_metadata")
    named = lines.select(
        F.col("value").alias("text"), place["file_path"].alias("file"), place["file_block_start"].alias("start")
    )
    return named.withColumn("quotes", _count(F.col("text"), '"').cast("long"))


def open_splits(lines: DataFrame) -> DataFrame:
    """``(file, start)`` of the splits that begin inside a quoted field."""
    splits = lines.groupBy("file", "start").agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    return splits.select("file", "start", inside.alias("inside")).filter("inside").select("file", "start")


def _joined(lines: list[pa.Array]) -> str:
    return "\n".join(x for part in lines for x in part.to_pylist())


class _Split:
    """The lines of one split that are not yet part of a whole record."""

    def __init__(self, file: str, start: int, inside: bool) -> None:
        self.file, self.start = file, start
        self.odd = int(inside)
        self.began_inside = inside
        self.is_first = start == 0
        self.waiting: list[pa.Array] = []

    def batch(self, kind: int, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        firsts = np.zeros(n, bool)
        firsts[:1] = self.is_first
        self.is_first = False
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.start)), pa.array(np.full(n, kind, np.int32)),
                pa.array(firsts), texts.cast(pa.large_string()),
            ],
            schema=PIECES_ARROW,
        )

    def add(self, lines: pa.Array, quotes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The records that end in these lines; before them the rest of one that began in an earlier split."""
        odd = (self.odd + np.cumsum(quotes)) % 2
        self.odd = int(odd[-1])
        ends = np.flatnonzero(odd == 0) + 1
        if not len(ends):
            self.waiting.append(lines)
            return
        first = int(ends[0])
        begun = pa.array([_joined([*self.waiting, lines.slice(0, first)])], pa.large_string())
        yield self.batch(HEAD if self.began_inside else RECORD, begun)
        self.began_inside = False
        if len(ends) > 1:
            bounds = pa.array(ends.astype(np.int32))
            whole = pa.ListArray.from_arrays(bounds, lines)
            yield self.batch(RECORD, pc.binary_join(whole, "\n"))
        rest = lines.slice(int(ends[-1]))
        self.waiting = [rest] if len(rest) else []

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            yield self.batch(MIDDLE if self.began_inside else TAIL, pa.array([_joined(self.waiting)], pa.large_string()))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records from ``(file, start, inside, quotes, text)`` in order."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, inside, text = (batch.column(c) for c in ("file", "start", "inside", "text"))
        quotes = batch.column("quotes").to_numpy()
        code = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place = start.to_numpy()
        new = np.flatnonzero((np.diff(code) != 0) | (np.diff(place) != 0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            key = file[a].as_py(), start[a].as_py()
            if held is None or (held.file, held.start) != key:
                if held is not None:
                    yield from held.end()
                held = _Split(*key, inside[a].as_py())
            yield from held.add(text.slice(a, b - a), quotes[a:b])
    if held is not None:
        yield from held.end()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(text, is_first)``: every record of the files, with its line breaks; blank lines are none.

    Quotes inside a field must be doubled, and only quoted fields may hold them. Lines end
    in LF or CR LF. A field whose quotes are never closed ends with its file.
    """
    lines = file_lines(spark, path)
    inside = stored(open_splits(lines), "open-splits").withColumn("inside", F.lit(True))
    n = inside.count()
    if n <= MAX_OPEN_SPLITS:
        found = lines.join(broadcast_if(True, inside), ["file", "start"], "left")
    else:
        keyed = lines.withColumn("at", F.monotonically_increasing_id())
        found = keyed.join(inside, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "at")
    found = found.select("file", "start", F.coalesce("inside", F.lit(False)).alias("inside"), "quotes", "text")
    parts = found.mapInArrow(pieces, PIECES)
    whole = parts.filter(F.col("kind") == RECORD).select("text", "is_first")
    # Pieces in order of their place; a tail begins the next record that crosses a border.
    broken = parts.filter(F.col("kind") != RECORD)
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = broken.withColumn("record", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
    crossing = numbered.groupBy("file", "record").agg(text.alias("text"), F.bool_or("is_first").alias("is_first"))
    records = whole.unionByName(crossing.select("text", "is_first"))
    # A carriage return before the line break is no part of the last field.
    bare = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, char_length(text) - 1)")).otherwise(F.col("text"))
    return records.select(bare.alias("text"), "is_first").filter("text <> ''")


def read_quoted_csv(spark: SparkSession, path: str, schema: str, header: bool = True, options: dict[str, str] | None = None) -> DataFrame:
    """Columns of ``schema`` by position; with a ``header``, the first record of each file is left out."""
    records = csv_records(spark, path)
    if header:
        records = records.filter("NOT is_first")
    parsing = {"quote": '"', "escape": '"', "multiLine": "true"} | (options or {})
    return records.select(F.from_csv("text", schema, parsing).alias("r")).select("r.*")

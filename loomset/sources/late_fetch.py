"""Wide columns read after the joins, by the place of their rows in Parquet files.

Joins and sorts carry keys, a file and a row number. What they select is then put in order
of place, and each task reads the wide columns of its rows from the files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomset.sources.storage import stored

FILE, ROW = "_loomset_file", "_loomset_row"
#: Bytes of fetched columns that a task gives away at a time.
BATCH_BYTES = 32 << 20
#: Rows of a file that a task holds at a time, about so many bytes of them as the file counts, and of those that are
#: still packed. Repeated values count once in a file, so the number of rows is bounded as well.
READ_BYTES, READ_ROWS, BUFFER_BYTES = 8 << 20, 256, 4 << 20


def is_plain_scan(df: DataFrame) -> bool:
    """Whether the table is columns of files as they stand: no row is dropped, made or computed."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias", "View"):
        if plan.nodeName() == "Project":
            items = plan.projectList()
            if any(items.apply(i).getClass().getSimpleName() != "AttributeReference" for i in range(items.size())):
                return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def with_places(df: DataFrame) -> DataFrame:
    """The rows with their file and row number; a table that is no plain scan of Parquet files is written first."""

    def placed(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.select("*", place["file_path"].alias(FILE), place["row_index"].alias(ROW))

    if is_plain_scan(df):
        try:
            return placed(df)
        except AnalysisException:  # a format without row numbers
            pass
    return placed(stored(df, "placed"))


def row_bytes(table: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row: of binary columns and strings as they are, of others on average."""
    size = np.zeros(table.num_rows)
    for column in table.columns:
        if any(is_(column.type) for is_ in (pa.types.is_binary, pa.types.is_large_binary, pa.types.is_string, pa.types.is_large_string)):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        else:
            size += column.nbytes / max(table.num_rows, 1)
    return size


class _Files:
    """A run of rows of the file that was read last; rows come in order of place."""

    def __init__(self, columns: Sequence[str]) -> None:
        self.columns = list(columns)
        self.path: str | None = None
        self.file: pq.ParquetFile
        self.starts: np.ndarray
        self.group = -1
        self.runs: Iterator[pa.RecordBatch]
        self.low = 0
        self.table: pa.RecordBatch | None = None

    def hold(self, number: int) -> int:
        """Read on to the run that has a row; returns the number of the row after that run."""
        group = int(np.searchsorted(self.starts, number, side="right")) - 1
        if group != self.group or number < self.low:
            part = self.file.metadata.row_group(group)
            run = min(READ_ROWS, max(1, READ_BYTES * part.num_rows // max(part.total_byte_size, 1)))
            self.runs = self.file.iter_batches(batch_size=run, row_groups=[group], columns=self.columns)
            self.group, self.low, self.table = group, int(self.starts[group]), None
        end = self.low + (self.table.num_rows if self.table is not None else 0)
        while number >= end:
            self.table, self.low = None, end
            self.table = next(self.runs)
            end += self.table.num_rows
        return end

    def rows(self, path: str, numbers: np.ndarray) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        """(first, after the last) of ``numbers`` and their columns, in pieces of about BATCH_BYTES."""
        if path != self.path:
            files, name = FileSystem.from_uri(path)
            self.file = pq.ParquetFile(files.open_input_file(name), buffer_size=BUFFER_BYTES)
            self.path, self.group = path, -1
            sizes = [self.file.metadata.row_group(i).num_rows for i in range(self.file.num_row_groups)]
            self.starts = np.cumsum([0, *sizes])
        at = 0
        while at < len(numbers):
            stop = int(np.searchsorted(numbers, self.hold(int(numbers[at]))))
            own = numbers[at:stop] - self.low
            piece = np.cumsum(row_bytes(self.table)[own]) // BATCH_BYTES
            borders = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(own)]
            for a, b in zip(borders, borders[1:]):
                yield at + a, at + b, self.table.take(pa.array(own[a:b]))
            at = stop


def fetch(rows: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` of ``source`` instead of their places; null where a place is null.

    ``source`` comes from ``with_places`` and ``rows`` has its places. The rows, narrow still, are written once
    with a number each, and dealt out in ranges of places: a row group is read by few tasks, and
    the rows of one popular place may lie in several ranges. No shuffle holds a fetched column, and no task a
    whole row group of them.
    """
    kept = [c for c in rows.columns if c not in (FILE, ROW)]
    narrow = stored(rows.select(*kept, FILE, ROW, F.monotonically_increasing_id().alias("_loomset_spread")), "narrow")
    ordered = narrow.repartitionByRange(FILE, ROW, "_loomset_spread").sortWithinPartitions(FILE, ROW).drop("_loomset_spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Files(columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column(FILE)
            code = files.dictionary_encode().indices
            code = code.fill_null(-1).to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            for a, b in zip(borders, borders[1:]):
                own = batch.slice(a, b - a)
                if code[a] < 0:
                    yield together(own, None)
                    continue
                for i, j, found in held.rows(files[a].as_py(), own.column(ROW).to_numpy()):
                    yield together(own.slice(i, j - i), found)

    def together(own: pa.RecordBatch, found: pa.RecordBatch | None) -> pa.RecordBatch:
        arrays = [own.column(c) for c in kept]
        for c in columns:
            arrays.append(pa.nulls(own.num_rows) if found is None else found.column(c))
        batch = pa.RecordBatch.from_arrays(arrays, [*kept, *columns])
        return batch.cast(target) if found is None or not batch.schema.equals(target) else batch

    fields = [*[rows.schema[c] for c in kept], *[source.schema[c] for c in columns]]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    target = to_arrow_schema(StructType.fromDDL(shape))
    return ordered.mapInArrow(run, shape)

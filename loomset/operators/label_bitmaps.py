"""Label pairs of rows with many labels, counted by intersections of bitmaps.

``labels.label_cooccurrence`` lists the pairs of each row, which suits rows of a few labels. With hundreds of
labels a row those lists grow with the square; here a block of rows is one bitmap a label, and a pair is
counted by the common bits, 64 rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block of rows and labels, and pairs that a task holds before it returns them.
BLOCK_CELLS, MAX_PAIRS = 32 << 20, 1 << 20
PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _bitmaps(row: np.ndarray, code: np.ndarray, rows: int, labels: int) -> np.ndarray:
    """``[labels, words]`` of 64 bits: which of the rows have each label."""
    cells = np.zeros((labels, -(-rows // 64) * 64), bool)
    cells[code, row] = True
    return np.packbits(cells, axis=1).view(np.uint64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


class _PairCounts:
    """Counts of pairs of labels; names are numbered in the order in which the task meets them."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, names: list[str]) -> np.ndarray:
        for name in names:
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
        return np.array([self.number[n] for n in names], np.int64)

    def add(self, bits: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for i in range(len(bits)):
            common = np.bitwise_count(bits[i] & bits[i:]).sum(axis=1, dtype=np.int64)
            at = np.flatnonzero(common)
            a, b = np.minimum(number[i], number[i + at]), np.maximum(number[i], number[i + at])
            keys.append(a << 31 | b)
            counts.append(common[at])
            held += len(at)
            if held > MAX_PAIRS or i == len(bits) - 1:
                self.keys, self.counts = _summed(np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts]))
                keys, counts, held = [], [], 0
                if len(self.keys) > MAX_PAIRS:
                    yield from self.take()

    def take(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.keys), 100_000):
            keys = self.keys[at : at + 100_000]
            pairs = [sorted((self.names[x], self.names[y])) for x, y in zip((keys >> 31).tolist(), (keys & (1 << 31) - 1).tolist())]
            columns = [pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), pa.array(self.counts[at : at + 100_000])]
            yield pa.RecordBatch.from_arrays(columns, schema=PAIRS)
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)


def cooccurrence_by_bitmaps(df: DataFrame, labels: str) -> DataFrame:
    """``(a, b, n_ab)`` as ``labels.label_cooccurrence``: rows that have both labels, ``a = b`` being the label's own count.

    Labels are strings; repeats within a row collapse, null labels and null rows count nothing. The work of
    a block is the square of its labels times a 64th of its rows, whatever the number of labels a row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _PairCounts()
        for batch in batches:
            lists = batch.column(0)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row, values = np.repeat(np.arange(len(lists)), lengths), lists.flatten()
            given = np.asarray(values.is_valid())
            row, values = row[given], values.drop_null()
            if not len(values):
                continue
            step = max(64, BLOCK_CELLS // len(values.unique()))
            for at in range(0, len(lists), step):
                low, high = np.searchsorted(row, [at, at + step])
                coded = values.slice(low, high - low).dictionary_encode()
                if len(coded):
                    code = coded.indices.to_numpy(zero_copy_only=False)
                    bits = _bitmaps(row[low:high] - at, code, step, len(coded.dictionary))
                    yield from held.add(bits, held.numbers(coded.dictionary.to_pylist()))
        yield from held.take()

    counted = df.select(F.col(labels).cast("array<string>").alias("labels")).mapInArrow(count, "a STRING, b STRING, n BIGINT")
    upper = counted.groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return upper.select(F.explode(F.array_distinct(both)).alias("p"), "n_ab").select("p.a", "p.b", "n_ab")

"""Hashed word shingles of Arrow text batches, computed for all texts of a slice at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bits of a shingle's id; the bits above hold the row within a slice.
ID_BITS = np.uint64(44)
SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes() -> np.ndarray:
    """A random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def slices(batch: pa.RecordBatch, *texts: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes; one row at least."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for name in texts:
        column = batch.column(name).cast(pa.large_binary())
        sizes += np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1])
    start, room = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and room + size > limit:
            yield batch.slice(start, i - start)
            start, room = i, 0
        room += size
    if batch.num_rows > start:
        yield batch.slice(start)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, in order. Words are runs of anything but ASCII white space."""
    flat = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if ends[-1] == ends[0]:
        return none
    data = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    begins = word & (first[:-1] | ~np.concatenate(([False], word[:-1])))
    stops = word & (first[1:] | ~np.concatenate((word[1:], [False])))
    starts, lasts = np.flatnonzero(begins), np.flatnonzero(stops)
    if not len(starts):
        return none
    powers = np.cumprod(np.full(len(data), ODD))
    sums = np.cumsum(byte_codes()[data] * powers)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    back = np.cumprod(np.full(len(data), INVERSE))[starts]
    hashes = mix((sums[lasts] - before) * back + (lasts - starts).astype(np.uint64))
    return np.searchsorted(ends, starts, side="right") - 1, hashes


def shingle_keys(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Sorted ``row << 44 | id`` of every shingle, repeats included.

    A text of fewer words than a shingle has one shingle of all its words; a text
    without words, or null, has none.
    """
    row, words = word_hashes(texts)
    if not len(row):
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64))
    n = len(row) - width + 1
    whole, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        same = row[:n] == row[width - 1 :]
        whole = sum((words[k : k + n] * factors[k] for k in range(width)), np.zeros(n, np.uint64))[same]
        of = row[:n][same]
    begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    lengths = np.diff(np.append(begins, len(row)))
    short = lengths < width
    if short.any():
        place = np.minimum(np.arange(len(row)) - np.repeat(begins, lengths), width - 1)
        joined = np.add.reduceat(words * factors[place], begins)[short]
        whole, of = np.concatenate((whole, joined)), np.concatenate((of, row[begins][short]))
    keys = (of.astype(np.uint64) << ID_BITS) | (mix(whole) >> np.uint64(64 - int(ID_BITS)))
    keys.sort()
    return keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, times) of the distinct shingles of each row, ordered by row and id."""
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(keys)))
    found = keys[new]
    return (found >> ID_BITS).astype(np.int64), found & ((np.uint64(1) << ID_BITS) - np.uint64(1)), times

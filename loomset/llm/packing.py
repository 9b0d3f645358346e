"""Hierarchical packing of documents into token sequences of several lengths."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.llm.byte_encoding import encoder

#: Window lengths, from long to short; each is a power of two.
TIERS = (1024, 512, 256)
END_ID = 0
#: A gap of a long window that is left as padding rather than filled by cutting a document.
LEAST_CUT = 8
#: Tokens of a training step; bytes that are packed at a time, and those that a document takes besides its ids.
STEP_TOKENS = 8192
CHUNK_BYTES, ROW_BYTES = 8 << 20, 300


@dataclass(order=True)
class Piece:
    """A run of a document's ids that is not placed yet."""

    length: int
    order: int
    start: int
    row: tuple  # (key, ids with the end id)

    def head(self, n: int) -> Piece:
        return Piece(n, self.order, self.start, self.row)

    def rest(self, n: int) -> Piece:
        return Piece(self.length - n, self.order, self.start + n, self.row)


def take(pools: list[list[Piece]], order: list[int], gap: int, exact: bool) -> Piece | None:
    """The longest piece that fits a gap, from the first of the ``order``ed tiers that has one.

    If none fits, or only an exact filling will do, the longest piece of the first tier that has any is cut.
    """
    for i in order:
        at = bisect_right(pools[i], gap, key=lambda p: p.length)
        if at:
            return pools[i].pop(at - 1)
    if not exact and gap < LEAST_CUT:
        return None
    for i in order:
        if pools[i]:
            piece = pools[i].pop()
            rest = piece.rest(gap)
            insort(pools[tier_of(rest.length)], rest)
            return piece.head(gap)
    return None


def tier_of(length: int) -> int:
    """The place of the shortest window that holds ``length``."""
    return max(i for i, window in enumerate(TIERS) if length <= window)


def pack(pieces: list[Piece], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(tier, pieces) of each sequence, and the pieces left for the next call.

    Full long windows are cut off first and what remains of a document is routed to the
    shortest window that holds it. Windows are opened by pieces of their own tier, and their
    gaps filled from the tiers below, and from their own where those are used up. A window is opened only
    if what is left fills it, so less than one long window of tokens is left, whatever the
    lengths; shorter windows are always full, as they carry no padding. ``last`` packs the rest, too: it
    goes into sequences whose lengths are powers of two.
    """
    done: list[tuple[int, list[Piece]]] = []
    pools: list[list[Piece]] = [[] for _ in TIERS]
    for piece in pieces:
        while piece.length >= TIERS[0]:
            done.append((TIERS[0], [piece.head(TIERS[0])]))
            piece = piece.rest(TIERS[0])
        if piece.length:
            pools[tier_of(piece.length)].append(piece)
    for pool in pools:
        pool.sort()
    for i, window in enumerate(TIERS):
        order = [*range(i + 1, len(TIERS)), i]
        room = sum(p.length for pool in pools[i:] for p in pool)
        while pools[i] and room >= window:
            held = [pools[i].pop()]
            gap = window - held[0].length
            while gap and (piece := take(pools, order, gap, window < TIERS[0])) is not None:
                held.append(piece)
                gap -= piece.length
            done.append((window, held))
            room -= window - gap
    left = [p for pool in pools for p in pool]
    if last:
        total = sum(p.length for p in left)
        while total:
            size = min(TIERS[0], 1 << (total.bit_length() - 1))
            held, gap = [], size
            while gap:
                piece = left.pop()
                if piece.length > gap:
                    left.append(piece.rest(gap))
                    piece = piece.head(gap)
                held.append(piece)
                gap -= piece.length
            done.append((size, held))
            total -= size
    return done, left


def steps(sequences: list[tuple[int, list[Piece]]]) -> list[int]:
    """A step number for each sequence: steps of one tier hold alike numbers of tokens and costs.

    The cost of a sequence is the sum of its pieces' squared lengths, as in attention;
    sequences are dealt to a tier's steps by falling cost, there and back.
    """
    out, base = [0] * len(sequences), 0
    for size in sorted({tier for tier, _ in sequences}, reverse=True):
        own = [i for i, (tier, _) in enumerate(sequences) if tier == size]
        own.sort(key=lambda i: (-sum(p.length**2 for p in sequences[i][1]), i))
        n = -(-len(own) * size // STEP_TOKENS)
        for k, i in enumerate(own):
            lap, at = divmod(k, n)
            out[i] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
    return out


def pack_documents(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, tier, step_id, ids.

    ``ids`` are little-endian 32-bit token ids; a document's ids end with the id 0, which
    ``doc_tokens`` counts. Documents are encoded and packed where they are read, in chunks
    of bounded size, without a shuffle; what a chunk leaves open, fewer tokens than one long
    window, goes to the next one.
    Sequence and step numbers hold the partition's number in their upper bits. Null texts
    are empty, and an empty document is its end id. Repeated rows are packed each on
    their own; a null key stays null; an empty table gives an empty one.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    numbers = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)])
    for name in numbers:
        schema = schema.add(name, T.LongType())
    schema = schema.add("tier", T.IntegerType()).add("step_id", T.LongType()).add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode
        base, end = TaskContext.get().partitionId() << 36, END_ID.to_bytes(4, "little")
        n_sequences = n_steps = seen = size = 0
        pending: list[Piece] = []
        kind = pa.null()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences, n_steps, pending
            sequences, pending = pack(pending, last)
            step = steps(sequences)
            for at in range(0, len(sequences), 1024):
                out: list[list] = [[] for _ in range(9)]
                for i, (tier, held) in enumerate(sequences[at : at + 1024], at):
                    offset = 0
                    for p in held:
                        ids = p.row[1][4 * p.start : 4 * (p.start + p.length)]
                        values = (p.row[0], p.start, p.length, len(p.row[1]) // 4, base + n_sequences + i, offset)
                        for column, value in zip(out, (*values, tier, base + n_steps + step[i], ids), strict=True):
                            column.append(value)
                        offset += p.length
                kinds = (kind, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=schema.names)
            n_sequences += len(sequences)
            n_steps += max(step, default=-1) + 1

        for batch in batches:
            kind = batch.column("key").type
            for k, t in zip(batch.column("key"), batch.column("text"), strict=True):
                ids = encode(t.as_py() or "") + end
                pending.append(Piece(len(ids) // 4, seen, 0, (k.as_py(), ids)))
                seen, size = seen + 1, size + len(ids) + ROW_BYTES
                if size > CHUNK_BYTES:
                    yield from flush(False)
                    size = 0
        if pending:
            yield from flush(True)

    return rows.mapInArrow(run, schema)

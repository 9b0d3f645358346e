"""SentencePiece encoding of merge-type models by a table of each prefix's last token.

In a merge-type (BPE) model every prefix of a text has one last token: the token that
ends there and is compatible with the last token of the prefix before it. The tokens
that end at each place come from an automaton over the vocabulary, and compatibility
of two neighbours is settled by splitting them in the reverse order of their merges.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomset.llm.workers import per_worker, share

SPACE = "▁"
#: Segments and pairs kept at a time; all are dropped when there are more.
MAX_WORDS = 800_000
#: Longer segments are not kept.
MAX_WORD_CHARS = 64
MAX_PAIRS = 1_000_000


@dataclass
class Pieces:
    """A model's vocabulary: ids, scores, and the ids of bytes, the end and control symbols."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    end: int
    surface: list[bytes]
    silent: frozenset[int]

    @classmethod
    def load(cls, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        silent = {i for i in range(len(names)) if model.is_control(i)}
        octets = {int(names[i][1:-1], 16): i for i in range(len(names)) if model.is_byte(i)}
        other = silent | set(octets.values()) | {i for i in range(len(names)) if model.is_unknown(i) or model.is_unused(i)}
        plain = {name: i for i, name in enumerate(names) if i not in other}
        if len(octets) != 256 or any(SPACE in name.lstrip(SPACE) for name in plain):
            raise ValueError("the model needs byte pieces, and spaces only at the start of its pieces")
        surface = [name.replace(SPACE, " ").encode() for name in names]
        for value, i in octets.items():
            surface[i] = bytes([value])
        for i in silent:
            surface[i] = b""
        scores = {name: model.get_score(i) for name, i in plain.items()}
        return cls(scores, plain, [octets[b] for b in range(256)], model.eos_id(), surface, frozenset(silent))


def merged(text: str, pieces: Pieces, above: float = -np.inf) -> list[str]:
    """Merge neighbours, best score first and leftmost among equals, while the score is over ``above``.

    The plain form of the merge rule: it builds the table of splits, and encodes runs of
    spaces, whose pieces have equal scores.
    """
    parts, alive = list(text), [True] * len(text)
    left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
    queue: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts):
            whole = parts[i] + parts[j]
            score = pieces.scores.get(whole)
            if score is not None and score > above:
                heapq.heappush(queue, (-score, i, j, whole))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while queue:
        _, i, j, whole = heapq.heappop(queue)
        if not alive[i] or j >= len(parts) or not alive[j] or right[i] != j or parts[i] + parts[j] != whole:
            continue
        parts[i], alive[j], right[i] = whole, False, right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [p for p, a in zip(parts, alive, strict=True) if a]


@dataclass
class MergeTable:
    """Tokens numbered by the order of their merges, single characters first, with their splits."""

    names: list[str]
    halves: list[tuple[int, int]]
    joined: dict[tuple[int, int], int]
    ids: list[int]
    spines: dict[tuple[int, int], list[int]] = field(default_factory=dict)

    def spine(self, token: int, side: int) -> list[int]:
        """A token and its halves on one side, down to a character; each is taken away by the merge of the one before."""
        found = self.spines.get((token, side))
        if found is None:
            half = self.halves[token][side]
            found = self.spines[token, side] = [token] if half == token else [token, *self.spine(half, side)]
        return found

    @classmethod
    def build(cls, pieces: Pieces) -> MergeTable:
        """Leave out pieces that merging cannot reach, and runs of spaces."""
        single = [name for name in pieces.ids if len(name) == 1]
        longer = sorted((n for n in pieces.ids if len(n) > 1 and n.strip(SPACE)), key=lambda n: -pieces.scores[n])
        names, halves, joined = list(single), [(i, i) for i in range(len(single))], {}
        place = {name: i for i, name in enumerate(single)}
        for name in longer:
            parts = merged(name, pieces, above=pieces.scores[name])
            if len(parts) == 2 and parts[0] in place and parts[1] in place:
                pair = place[parts[0]], place[parts[1]]
                place[name] = joined[pair] = len(names)
                names.append(name)
                halves.append(pair)
        return cls(names, halves, joined, [pieces.ids[n] for n in names])


def compatible(table: MergeTable, left: int, right: int) -> bool:
    """Whether two tokens can stand side by side: no merge across their border comes first.

    At the border stand, one after the other as merging goes on, the tokens of the left one's right spine
    and of the right one's left spine. Two that stand there together are merged if their
    joint token has an earlier number than the merges that take either of them away; among equal
    numbers the leftmost merge is first. The pairs are gone through from the last one back.
    """
    lefts, rights, joined = table.spine(left, 1), table.spine(right, 0), table.joined.get
    i = j = 0
    a, b = left, right
    a_taken = b_taken = never = len(table.names)
    while True:
        made = joined((a, b), never)
        if made < a_taken and made <= b_taken:
            return False
        if a > b:  # the left one was made later, so its half stood there before
            i += 1
            if i == len(lefts):
                return True
            a, a_taken = lefts[i], a
        else:
            j += 1
            if j == len(rights):
                return True
            b, b_taken = rights[j], b


def segment_pattern(pieces: Pieces) -> str:
    """A pattern of the segments of a text, each with the spaces before it, that no piece spans.

    Characters that follow each other in a piece are of one group, so two neighbours of different groups
    never merge. A character that follows none, nor itself, is a segment, as is an unknown one.
    """
    group = {c: c for c in pieces.ids if len(c) == 1 and c != SPACE}
    joined = set()

    def first(c: str) -> str:
        while group[c] != c:
            group[c] = c = group[group[c]]
        return c

    for name in pieces.ids:
        chars = name.lstrip(SPACE)
        for a, b in zip(chars, chars[1:]):
            if a in group and b in group:
                group[first(a)] = first(b)
                joined |= {a, b}
    groups: dict[str, list[str]] = {}
    for c in sorted(group):
        groups.setdefault(first(c) if c in joined else "", []).append(re.escape(c))
    lone = groups.pop("", [])
    kinds = [f"[{''.join(x)}]+" for x in sorted(groups.values(), key=len, reverse=True)] + ([f"[{''.join(lone)}]"] if lone else [])
    return f"{SPACE}*+(?:{'|'.join(kinds)})|{SPACE}+|."


@dataclass
class PieceEncoder:
    """Encodes and decodes whole texts; frequent segments are kept with their ids."""

    pieces: Pieces
    table: MergeTable
    words: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for number, name in enumerate(self.table.names):
            self.automaton.add_word(name, (number, len(name)))
        self.automaton.make_automaton()
        self.segments = re.compile(segment_pattern(self.pieces), re.DOTALL)
        self.end = array("i", [self.pieces.end]).tobytes()
        self.surface = pa.array(self.pieces.surface, pa.large_binary())
        self.octets = frozenset(self.pieces.byte_ids)
        self.lengths = [len(name) for name in self.table.names]

    def run(self, text: str) -> list[int]:
        """Ids of characters that are all in the vocabulary, recovered backwards from the table."""
        pairs, get, size = self.pairs, self.pairs.get, len(self.table.names)
        if len(pairs) > MAX_PAIRS:
            pairs.clear()
        numbers, done = [-1] * len(text), -1
        for stop, (number, length) in self.automaton.iter(text):
            if stop != done:  # the tokens that end at one place come one after the other
                if stop >= length:
                    before = numbers[stop - length]
                    if before < 0:
                        continue
                    pair = before * size + number
                    fits = get(pair)
                    if fits is None:
                        fits = pairs[pair] = compatible(self.table, before, number)
                    if not fits:
                        continue
                numbers[stop] = number
                done = stop
        out, at, ids, lengths = [], len(text) - 1, self.table.ids, self.lengths
        while at >= 0:
            number = numbers[at]
            out.append(ids[number])
            at -= lengths[number]
        out.reverse()
        return out

    def segment(self, text: str) -> bytes:
        """Ids of a segment with the spaces before it; an unknown character becomes its bytes."""
        if text.startswith(SPACE * 2):
            ids = []
            for part in merged(text, self.pieces):
                own = self.pieces.ids.get(part)
                ids.extend([own] if own is not None else [self.pieces.byte_ids[b] for b in part.encode()])
        elif len(text) > 1 or text in self.pieces.ids:
            ids = self.run(text)
        else:
            ids = [self.pieces.byte_ids[b] for b in text.encode()]
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text and the end id. No piece spans two segments."""
        if not text:
            return self.end
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        known = self.words
        parts = self.segments.findall(SPACE + text.replace(" ", SPACE))
        out = list(map(known.get, parts))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    part = parts[i]
                    ids = out[i] = known.get(part) or self.segment(part)
                    if len(part) <= MAX_WORD_CHARS:
                        known[part] = ids
        out.append(self.end)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control symbols are silent and the space before the first word goes.

        Bytes that form no character become a replacement character each.
        """
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_lists(self, lists: pa.ListArray) -> list[str | None]:
        """The text of each list of ids; of a null list, null."""
        ends = lists.offsets.to_numpy()
        ids = lists.values.slice(ends[0], ends[-1] - ends[0])
        if ids.null_count:
            raise ValueError("a list of ids holds a null")
        found = self.surface.take(ids)
        places = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1)[ends - ends[0]].tolist()
        data, ends, out = memoryview(found.buffers()[2] or b""), ends.tolist(), []
        silent, octets = self.pieces.silent, self.octets
        for i, valid in enumerate(lists.is_valid().to_pylist()):
            if not valid:
                out.append(None)
                continue
            whole = data[places[i] : places[i + 1]]
            if len(whole) and whole[0] == 32:
                own = (ids[k].as_py() for k in range(ends[i] - ends[0], ends[i + 1] - ends[0]))
                if next(k for k in own if k not in silent) not in octets:
                    whole = whole[1:]
            try:
                out.append(str(whole, "utf-8"))
            except UnicodeDecodeError:
                out.append(one_by_one(bytes(whole)))
        return out


def one_by_one(data: bytes) -> str:
    """Decode UTF-8 with a replacement character for every byte that is part of no character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _shared(df: DataFrame, path: str) -> Callable[[], PieceEncoder]:
    """An encoder in each worker, with the model's tables made on the driver."""
    pieces, name = Pieces.load(path), zlib.crc32(Path(path).read_bytes())
    get = share(df.sparkSession, lambda tables=(pieces, MergeTable.build(pieces)): PieceEncoder(*tables))
    return lambda: per_worker(("piece-encoder", name), lambda: get()())


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its text replaced by ``ids``, an array that ends with the end id.

    Narrow. A null text is an empty one, which has the end id only; rows keep their
    order and repeats. A column named ``ids`` is replaced.
    """
    get, kept = _shared(docs, model_path), [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                found = [encoder.encode(t or "") for t in piece.column(text).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], lists], names=[*kept, ids])

    return docs.mapInArrow(run, docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``text``. Null ids give a null text, no ids an empty one."""
    get, kept = _shared(encoded, model_path), [c for c in encoded.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                texts = encoder.decode_lists(piece.column(ids))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, text])

    return encoded.mapInArrow(run, encoded.select(*kept).schema.add(text, T.StringType()))

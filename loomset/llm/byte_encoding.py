"""Byte-pair encoding of whole texts with a given vocabulary."""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import tiktoken

from loomset.llm.workers import per_worker

#: Fixed value: the published word pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the added token of this family; its id follows the last rank.
END_OF_TEXT = "<|endoftext|>"
#: Longer runs of white space are cut out before the pattern is applied: the library keeps a
#: state per character of a run and panics at a million. White space is that of the pattern.
LONG = 100_000
LONG_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG},}}")


class ByteEncoder:
    """Ids of texts as little-endian 32-bit numbers; the end-of-text mark in a text is its one token."""

    def __init__(self, ranks_file: bytes):
        lines = (line.split() for line in ranks_file.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.end = max(ranks.values(), default=-1) + 1
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def words(self, text: str) -> list[int]:
        """The ids of a text without special tokens.

        The pattern leaves the last character of a run of white space to what follows, and
        takes the rest, or a run at the end of the text, as one word.
        """
        if len(text) < LONG:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for m in LONG_SPACE.finditer(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            ids += self.encoding.encode_ordinary(text[at : m.start()])
            ids += self.encoding._encode_single_piece(text[m.start() : stop])
            at = stop
        return ids + self.encoding.encode_ordinary(text[at:])

    def ids(self, text: str) -> list[int]:
        first, *more = text.split(END_OF_TEXT)
        ids = self.words(first)
        for part in more:
            ids.append(self.end)
            ids += self.words(part)
        return ids

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def encode(self, text: str) -> bytes:
        return array("i", self.ids(text)).tobytes()


def encoder(ranks_file: bytes) -> ByteEncoder:
    """This worker's encoder for the contents of a rank file."""
    return per_worker(("byte-encoder", zlib.crc32(ranks_file)), lambda: ByteEncoder(ranks_file))

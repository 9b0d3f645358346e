"""Token and string expressions.

Word characters are spelled out as ``[\\p{L}\\p{N}_]`` because the meaning of
``\\w`` and ``\\b`` differs between regex engines and Java versions; the long
form gives the Unicode meaning everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHARS = r"\p{L}\p{N}_"
CLEAN_TOKEN = rf"(?<![{WORD_CHARS}])[a-z]{{3,}}+(?![{WORD_CHARS}])"
# White space is Unicode, with the no-break spaces and the ASCII separators.
WORD_OR_PUNCT = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}\p{{IsWhite_Space}}\x1c-\x1f]"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def text_concat(title: Column, content: Column) -> Column:
    """``title + " " + content``; null when either side is null."""
    return F.concat(title, F.lit(" "), content)


def text_snippet(text: Column, length: int, null_text: str = "nan") -> Column:
    """First ``length`` characters; a missing text reads as ``null_text``."""
    return F.left(F.coalesce(text.cast("string"), F.lit(null_text)), F.lit(length))


def default_stop_words() -> list[str]:
    """Spark's English stop list (needs a running session)."""
    return StopWordsRemover.loadDefaultStopWords("english")


def clean_tokens(text: Column) -> Column:
    """Lower-cased whole words of three or more ASCII letters; null gives ``[]``.

    ``café`` and ``abc1`` contain other word characters, so they yield nothing.
    """
    found = F.regexp_extract_all(F.lower(text.cast("string")), F.lit(CLEAN_TOKEN), F.lit(0))
    return F.coalesce(found, _no_tokens())


def remove_stopwords(tokens: Column, stop_words: Iterable[str]) -> Column:
    """Drop stop words and keep everything else, duplicates included."""
    words = sorted(set(stop_words))
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def clean_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null stays null."""
    return F.size(F.filter(F.split(text, SPACE_RUN), lambda w: w != ""))


def tokenize_words_punct(text: Column) -> Column:
    """Lower-cased words and single punctuation marks, in text order."""
    found = F.regexp_extract_all(F.lower(text.cast("string")), F.lit(WORD_OR_PUNCT), F.lit(0))
    return F.coalesce(found, _no_tokens())


def bigrams(tokens: Column) -> Column:
    """Adjacent token pairs joined by a space; fewer than two tokens give ``[]``."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n - 1),
        F.slice(tokens, F.lit(2), n - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n >= 2, pairs).otherwise(_no_tokens())


# Fixed value: the words before a class name.
PROMPT_PREFIX = "A movie poster of the genre "


def prompt(name: Column, prefix: str = PROMPT_PREFIX) -> Column:
    return F.concat(F.lit(prefix), name)

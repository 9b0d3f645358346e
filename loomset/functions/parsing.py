"""Parsing of chat-style records into a plot text and a label list.

Two plot parsers and two label parsers are kept apart on purpose: they differ on
missing markers, repeated markers and white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.binding import let

# The markers around a description.
PLOT_MARKER = "Plot: "
NOTE_MARKER = "\nNote"
TRIM_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# The texts that a CSV reader of the pandas family takes as missing.
NA_LITERALS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(text, TRIM_EDGES, "")


def message(messages: Column, position: int) -> Column:
    """Content of the message at ``position``; null when there is none."""
    return F.get(messages, F.lit(position))["content"]


def plot_last(content: Column) -> Column:
    """Text after the last marker, or the whole text without a marker."""
    return F.substring_index(content, PLOT_MARKER, -1)


def plot_strict(content: Column) -> Column:
    """Text between the first and second marker, cut at the first note, trimmed.

    Null when the marker is missing.
    """
    segment = F.get(F.split(content, PLOT_MARKER), F.lit(1))
    return strip(F.get(F.split(segment, NOTE_MARKER), F.lit(0)))


def genres_trim(content: Column) -> Column:
    """Split on commas and trim each piece; empty pieces stay."""
    return F.transform(F.split(content, ","), strip)


def genres_raw(content: Column) -> Column:
    """Split on comma-space, no trimming."""
    return F.split(content, ", ")


def parse_strict(messages: Column) -> Column:
    """Struct ``(plot, genres)``; both are null when any step fails."""
    parts = F.struct(
        plot_strict(message(messages, 0)).alias("plot"), genres_raw(message(messages, 1)).alias("genres")
    )

    def both_or_none(p: Column) -> Column:
        ok = p["plot"].isNotNull() & p["genres"].isNotNull()
        return F.struct(F.when(ok, p["plot"]).alias("plot"), F.when(ok, p["genres"]).alias("genres"))

    return let(parts, both_or_none)


def pipe_join(labels: Column) -> Column:
    return F.array_join(labels, "|")


def pipe_split(text: Column) -> Column:
    """Pipe-separated text to an array; missing text gives ``[]``."""
    present = F.when(text != "", F.split(text, r"\|"))
    return F.coalesce(present, F.array().cast("array<string>"))


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(NA_LITERALS), text)

"""Groups of near copies among texts with frequent lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.binding import let
from loomset.llm.components import components
from loomset.llm.near_dedup import SIMILARITY, hub_pairs
from loomset.sources.storage import stored

WIDTH = 5
#: Smallest shingle hashes of a text that are kept. Texts of no more shingles are compared
#: exactly; of longer ones the similarity is estimated, with a deviation of 0.025 at 0.8.
SKETCH = 256
#: Of these, the ones that propose candidates: copies with 8 of 9 shingles of an original
#: miss all of them once in 500,000.
PROBES = 6


def sketch(words: Column) -> Column:
    """The smallest hashes of the shingles of a text, sorted; a text of fewer words has one shingle."""

    def shingles(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(hashes) - WIDTH, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(let(hashes, shingles))), 1, SKETCH)


def similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sketched texts."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)


def groups(sketches: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, component) of the texts that have near copies in their host.

    ``sketches`` has (host, text, sketch), with a key of host and text in ``text``. The
    texts of a bucket are compared with its hub alone, so a large group costs a pair each.
    """
    placed = sketches.select("text", F.explode(F.slice("sketch", 1, PROBES)).alias("hash"), "host")
    placed = placed.select(F.xxhash64("host", "hash").alias("bucket"), "text")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(placed.join(shared, "bucket"), "copy-buckets")
    side = lambda x: sketches.select(F.col("text").alias(x), F.col("sketch").alias(f"{x}_sketch"))
    both = hub_pairs(members).join(side("a"), "a").join(side("b"), "b")
    near = both.filter(similarity(F.col("a_sketch"), F.col("b_sketch")) >= least).select("a", "b")
    return components(stored(near, "copy-links"))

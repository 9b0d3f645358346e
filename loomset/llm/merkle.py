"""A manifest of hash trees: a leaf for every row, a tree for every source, and one tree over the sources.

A node's children are spread into one column a slot by conditional aggregates. All columns
joined and hashed give the node, all but one give the siblings of that child. Levels are built
upwards and written; then proofs come down from the root, where each parent's row gives its
children's at once, so a proof is never shuffled for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.sources.storage import stored

FANOUT = 16
#: What a proof holds for a level: the digests before the own one and those after it, each joined.
STEP = "struct<before: string, after: string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """The lowercase hex SHA-256 of strings one after the other."""
    return F.sha2(F.concat(*parts), 256)


def counted(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a row among those of its group from 0, and ``size``, their number.

    The rows are sorted in ranges, so a group that holds most of them spreads over many. A
    range numbers its own rows; counts of the groups of each range give the rest.
    """
    tie = F.monotonically_increasing_id().alias("tie")  # equal rows need not share a range
    keys = [group, *order, "tie"]
    ranges = rows.select("*", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ranges = stored(ranges.withColumn("mark", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("mark", 33).alias("part")
    starts = ranges.groupBy(group, part).agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col(group).alias("of"), "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("shift"),
        F.sum("n").over(Window.partitionBy(group)).alias("size"),
    )
    numbered = ranges.withColumn("part", part).alias("r").join(
        stored(starts, "range-starts").alias("s"), F.col(f"r.{group}").eqNullSafe(F.col("s.of")) & (F.col("r.part") == F.col("s.part"))
    )
    return numbered.select("r.*", "size", (F.col("mark") - F.col("shift")).alias("pos")).drop("mark", "part")


def slots(children: DataFrame, group: str, child: Column) -> DataFrame:
    """(group, size, pos, s0 ... s15): each parent's children, one column a slot."""
    own = [F.max(F.when(F.col("pos") % FANOUT == k, child)).alias(f"s{k}") for k in range(FANOUT)]
    parents = children.groupBy(group, F.floor(F.col("pos") / FANOUT).alias("parent")).agg(F.max("size").alias("size"), *own)
    return parents.withColumnRenamed("parent", "pos")


def names(value: str = "") -> list[Column]:
    """The digests of the slots."""
    return [F.col(f"s{k}{value}") for k in range(FANOUT)]


def levels(nodes: DataFrame, group: str, child: Column, field: str) -> tuple[list[DataFrame], DataFrame]:
    """(the parents of each level from the lowest, (group, top digest)) for nodes with ``pos`` and ``size``.

    A group's only node is its top as it stands. The lowest level has whole ``child`` values in its
    slots, whose digest is ``field``; the upper ones have digests.
    """
    most = nodes.agg(F.max("size")).first()[0] or 0
    made: list[DataFrame] = []
    tops: DataFrame | None = None
    while most > 1 or not made:
        suffix = "" if made else field
        hashed = F.sha2(F.concat_ws("", *names(suffix)), 256)
        one = F.when(F.col("size") > 1, hashed).otherwise(F.col(f"s0{suffix}"))
        made.append(stored(slots(nodes, group, child).withColumn("digest", one), "level"))
        above = F.ceil(F.col("size") / FANOUT)
        top = made[-1].filter(above == 1).select(group, F.col("digest").alias("top"))
        tops = top if tops is None else tops.union(top)
        nodes = made[-1].filter(above > 1).select(group, above.alias("size"), "pos", "digest")
        child, most = F.col("digest"), -(-most // FANOUT)
    return made, tops


def descend(made: list[DataFrame], tops: DataFrame, group: str, field: str) -> DataFrame:
    """(columns of ``tops``, child, path) for every child of the lowest level.

    ``tops`` has ``group`` and ``path``, the steps above a group's top; the path of a child starts
    with its own level. Each level joins as many rows as it has parents.
    """
    carried = [c for c in tops.columns if c not in (group, "path")]
    found: DataFrame | None = None
    for at in reversed(range(len(made))):
        level = made[at]
        size = F.ceil(F.col("l.size") / FANOUT)
        ends = tops.alias("t").join(level.filter(F.ceil(F.col("size") / FANOUT) == 1).alias("l"), F.col(f"t.{group}").eqNullSafe(F.col(f"l.{group}")))
        here = ends.select("t.*", *[F.col(f"l.{c}") for c in level.columns if c != group])
        if found is not None:
            upper = found.alias("t").join(
                level.filter(F.ceil(F.col("size") / FANOUT) > 1).alias("l"),
                F.col(f"t.{group}").eqNullSafe(F.col(f"l.{group}")) & (F.col("t.pos") == F.col("l.pos")),
            )
            here = here.unionByName(upper.select(*[F.col(f"t.{c}") for c in tops.columns], *[F.col(f"l.{c}") for c in level.columns if c != group]))
        suffix = "" if at else field
        texts = [F.concat_ws("", *names(suffix)[:k]) for k in range(FANOUT)], [F.concat_ws("", *names(suffix)[k + 1 :]) for k in range(FANOUT)]
        alone = F.col("size") == 1
        step = lambda k: F.struct(texts[0][k].alias("before"), texts[1][k].alias("after"))  # noqa: B023, E731
        children = F.array(*[
            F.struct(
                (F.col("pos") * FANOUT + k).alias("pos"), F.col(f"s{k}").alias("child"),
                F.when(alone, F.col("path")).otherwise(F.concat(F.array(step(k)), F.col("path"))).alias("path"),
            ) for k in range(FANOUT)
        ])
        out = here.select(group, *carried, F.explode(children).alias("c"))
        found = out.filter(F.col("c.child").isNotNull()).select(group, *carried, "c.pos", "c.child", "c.path")
    return found


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["before"], node, x["after"]))


def is_checked(doc_id: Column) -> Column:
    """Rows that an audit tampers with: 5 divides the CRC-32 of the decimal id; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def manifest(
    docs: DataFrame, tampered: Column | None = None, altered: Column | None = None,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source",
) -> DataFrame:
    """(key, leaf, subroot, root, path, found): the place of each row in a hash tree.

    A leaf is the SHA-256 of the row's ``fields``, each counted in bytes or ``-`` if null. The
    leaves of a group in order of ``key`` (nulls first, then equal keys by their leaves), 16 to a
    parent, give its subroot; the subroots in order of the group (null first, then UTF-8) give the root.
    A lone leaf is its subroot, a lone subroot the root. ``path`` has for each level the digests
    before and after the own one. ``found`` is the leaf as an audit finds it: that of
    the row with its last field replaced by ``altered`` where ``tampered``, else the leaf.

    Repeated rows are leaves each; a null group is a group of its own and not the empty one. An
    empty table gives an empty result. Other columns are not read.
    """
    parts = [counted(F.col(f)) for f in fields]
    leaf = digest(*parts)
    if tampered is None:
        found = F.lit(None).cast("string")
    else:
        found = F.when(tampered, digest(*parts[:-1], counted(altered)))
    leaves = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"), found.alias("found"))
    placed = positions(stored(leaves, "leaves"), "grp", ["key", "leaf"])
    child = F.struct("leaf", "key", "found")
    made, tops = levels(placed, "grp", child, ".leaf")
    tops = stored(tops.select(F.lit(0).alias("all"), "grp", "top"), "subroots")
    upper = positions(tops, "all", ["grp"])
    above, root = levels(upper, "all", F.struct("top", "grp"), ".top")
    start = root.select("all", F.col("top").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    paths = descend(above, start, "all", ".top")
    paths = stored(paths.select(F.col("child.grp").alias("grp"), F.col("child.top").alias("subroot"), "root", "path"), "subroot-paths")
    done = descend(made, paths, "grp", ".leaf")
    return done.select(
        F.col("child.key").alias(key), F.col("child.leaf").alias("leaf"), "subroot", "root", "path",
        F.coalesce("child.found", "child.leaf").alias("found"),
    )


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row checked against the manifest.

    Each row's leaf, with the text in lower case for the rows that ``is_checked`` picks, is folded with the
    siblings of its path and compared with the root. See ``manifest`` for odd rows.
    """
    done = manifest(docs, is_checked(F.col("doc_id")), lowered(F.col("text")))
    root = folded(F.col("found"), F.col("path"))
    done = done.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Quality classifier: rules from tree paths, lasso logistic weights, Spark column expressions.

Trees are grown on a bounded sample of labelled rows. Every path from a root to a node
is a conjunction of limits on text statistics; a lasso keeps few of these rules, and
the fitted score is one column expression that runs in the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions.binding import let
from loomset.llm.quality_rules import SPACE, repeated_words, split_words
from loomset.sources.storage import stored

#: The most labelled rows that a fit reads, taken by the hash of their id.
MAX_LABELLED = 20_000
THRESHOLD = 0.3

#: What a statistic counts, as the characters left after all others are removed.
COUNTED = {
    "symbol": r"[^#*$%&|<>]+",
    "upper": r"[^\p{Lu}]+",
    "letter": r"[^\p{L}]+",
    "digit": r"[^0-9]+",
    "bang": r"[^!?]+",
    "bar": r"[^|]+",
    "stop": r"[^.,;:]+",
}

Limit = tuple[str, bool, float]


def statistics(text: Column) -> Column:
    """A struct of numbers that describe a text. Null counts as empty; all are finite."""
    whole = F.coalesce(text, F.lit(""))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = F.struct(
        *[F.length(F.regexp_replace(whole, out, "")).cast("double").alias(name) for name, out in COUNTED.items()],
        F.length(F.regexp_replace(whole, SPACE, "")).cast("double").alias("chars"),
    )
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(x) > 20)
    share = lambda x, out: F.length(F.regexp_replace(x, out, "")) / F.length(x)
    worst = lambda out: F.coalesce(F.array_max(F.transform(lines, lambda x: share(x, out))), F.lit(0.0))

    def body(words: Column) -> Column:
        n = F.size(words).cast("double")
        again = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
        return let(
            counts,
            lambda c: F.struct(
                F.log1p(n).alias("log_words"),
                part(c["chars"], n).alias("word_chars"),
                *[part(c[name], c["chars"]).alias(f"{name}_share") for name in ("symbol", "letter", "digit", "bang")],
                part(c["bar"], n).alias("bars_per_word"),
                part(c["stop"], n).alias("stops_per_word"),
                part(c["upper"], c["letter"]).alias("upper_share"),
                part(F.size(F.array_distinct(words)), n).alias("distinct_share"),
                part(again, n).alias("stutter_share"),
                part(repeated_words(words), n).alias("repeat_share"),
                worst(COUNTED["symbol"]).alias("worst_line_symbols"),
                worst(COUNTED["upper"]).alias("worst_line_upper"),
            ),
        )

    return let(split_words(text), body)


@dataclass(frozen=True)
class RuleEnsemble:
    """A fitted score: intercept, and a weight for each conjunction of limits."""

    intercept: float
    rules: tuple[tuple[tuple[Limit, ...], float], ...] = ()

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as a column expression over a statistics struct."""
        total = F.lit(self.intercept)
        for limits, weight in self.rules:
            total = total + F.when(holds(limits, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(limits: tuple[Limit, ...], stats: Column) -> Column:
    """Whether all limits (name, at most, value) of a rule hold."""
    tests = [stats[name] <= value if below else stats[name] > value for name, below, value in limits]
    return reduce(lambda a, b: a & b, tests)


def tree_paths(model, names: list[str]) -> list[tuple[Limit, ...]]:
    """Every path of the forest's trees as a rule, without repeats, in a fixed order.

    A path keeps the tightest limit on each side of a statistic.
    """
    found: set[tuple[Limit, ...]] = set()

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found.add(tuple(sorted((name, below, value) for (name, below), value in path.items())))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, value = names[split.featureIndex()], float(split.threshold())
        for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
            tighter = min if below else max
            walk(child, path | {(name, below): tighter(value, path.get((name, below), value))})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return sorted(found)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, limit: int = MAX_LABELLED
) -> DataFrame:
    """(stats, label) of at most ``limit`` labelled rows, the first by the hash of their key.

    Rows without a label or a document are left out. The sample's keys are few enough to
    broadcast, so the texts stay where they are.
    """
    wanted = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).dropna()
    wanted = wanted.orderBy(F.xxhash64("key"), "key", "label").limit(limit)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(wanted), "key").select("key", statistics(F.col("text")).alias("stats"), "label")
    rows = rows.repartitionByRange(4, F.xxhash64("key"), "key").sortWithinPartitions(F.xxhash64("key"), "key", "label")
    return stored(rows, "labelled")


def fit(
    sample: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.001, seed: int = 7
) -> RuleEnsemble:
    """Grow trees on (stats, label), turn their paths into rules and weigh these by a lasso.

    Without rows the score is one half everywhere; with one label only, it is the
    smoothed share of that label.
    """
    names = sample.schema["stats"].dataType.names
    n, ones = sample.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)))
    rows = sample.select("stats", "label", array_to_vector(F.array(*[F.col(f"stats.{c}") for c in names])).alias("x"))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=10,
        subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=seed,
    )
    rules = tree_paths(forest.fit(rows), names)
    if not rules:
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)))
    hits = F.array(*[holds(r, F.col("stats")).cast("double") for r in rules])
    lasso = LogisticRegression(
        featuresCol="x", labelCol="label", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60
    )
    model = lasso.fit(stored(rows.select(array_to_vector(hits).alias("x"), "label"), "rule-hits"))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def is_held_out(key: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, remainder 0 by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> RuleEnsemble:
    """A score fitted on the labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels.filter(~is_held_out(F.col(key))), text, key, label))


def classify(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct ``quality``: score (0 to 1) and predicted (1 from the threshold on).

    Narrow: no shuffle. Null and empty texts are scored as texts without words; rows keep
    their order and repeats; a column named ``quality`` is replaced.
    """
    scored = model.score(F.col("stats"))
    done = docs.select(F.struct("*").alias("row"), statistics(F.col(text)).alias("stats"))
    done = done.select("row", scored.alias("score"))
    verdict = F.struct("score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c != "quality"]
    return done.select(*rest, verdict.alias("quality"))

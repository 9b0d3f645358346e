"""The analyses as a whole: operators chained over tables that are stored once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import parsing as ps
from loomset.functions import text as tx
from loomset.operators import corpus, labels, metrics, probe, scoring, splits, stats, tfidf
from loomset.operators.dense import class_similarity
from loomset.sources.storage import stored


def text_eda(
    df: DataFrame, category: str, text: str, stop_words: Iterable[str] | None = None, max_features: int = 5000
) -> dict[str, DataFrame]:
    """Corpus report per category.

    Texts are tokenised once, into a stored table that all later steps read.
    """
    words = tx.default_stop_words() if stop_words is None else stop_words
    base = stored(
        df.select(
            F.col(category).alias("category"),
            tx.word_count(F.col(text)).alias("word_count"),
            tx.remove_stopwords(tx.clean_tokens(F.col(text)), words).alias("tokens"),
        ),
        "tokens",
    )
    model = tfidf.fit_tfidf(base, "tokens", max_features)
    means = stored(tfidf.class_mean_vectors(base, model, "category", "tokens"), "class-means")
    return {
        "class_distribution": stats.class_distribution(base, "category"),
        "word_count_histogram": stats.quantile_histogram(base, "word_count"),
        "vocabulary_richness": corpus.vocabulary_richness(base, "category", "tokens"),
        "class_similarity": class_similarity(means, "category"),
        "top_terms": tfidf.top_terms(tfidf.class_mean_weights(means, model, "category"), "category"),
        "top_bigrams": corpus.top_bigrams(base, "category", "tokens"),
    }


def prepare_multimodal(
    records: DataFrame, id_col: str, messages: str, image_key: str, seed: int = 42
) -> dict[str, DataFrame]:
    """Chat records to a labelled, split metadata table, with the rejects beside it."""
    content, answer = ps.message(F.col(messages), 0), ps.message(F.col(messages), 1)
    checks = {"no description": content.isNotNull(), "no labels": answer.isNotNull()}
    good, rejects = labels.split_rejects(records, id_col, checks)
    metadata = stored(
        good.select(
            id_col,
            ps.plot_last(content).alias("plot"),
            F.col(image_key).alias("image_path"),
            ps.genres_trim(answer).alias("genres"),
        ),
        "metadata",
    )
    classes = labels.fit_classes(metadata, "genres")
    rows = labels.multi_hot(metadata, "genres", classes)
    return {
        "rows": splits.split_train_val_test(rows, id_col, seed),
        "classes": classes,
        "rejects": rejects,
        "label_counts": labels.label_counts(metadata, "genres"),
        "label_cardinality": labels.label_cardinality_distribution(metadata, "genres"),
        "label_correlation": labels.label_correlation(metadata, "genres"),
        "label_summary": labels.label_summary(metadata, "genres"),
    }


def evaluate_zero_shot(
    items: DataFrame,
    id_col: str,
    image: str,
    text: str,
    y_true: str,
    classes: DataFrame,
    class_col: str,
    class_vector: str,
    scale: float,
    cut: float = 0.1,
    sample: int | None = None,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Scores of the three modes on one fixed sample (None: all rows) and the fused report.

    The sample is scored once; the modes are projections of the stored result.
    """
    chosen = items if sample is None else splits.fixed_size_sample(items, id_col, sample, seed)
    scored = scoring.zero_shot_predict(
        chosen, id_col, image, text, classes, classes, class_col, class_vector, scale, cut
    )
    rows = stored(
        scoring.by_mode(scored.withColumnRenamed(y_true, "y_true"), [id_col, "y_true"]), "zero-shot"
    )
    names = classes.agg(F.sort_array(F.collect_set(class_col)).alias("classes"))
    return {
        "predictions": rows,
        "comparison": metrics.mode_comparison(rows, "mode", scoring.MODES),
        "report": metrics.classification_report(rows.where("mode = 'multimodal'"), names),
    }


def few_shot_experiment(
    items: DataFrame,
    id_col: str,
    image: str,
    text: str,
    y_true: str,
    n_classes: int,
    fraction: float = 0.05,
    cut: float = 0.3,
    passes: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Probes of the three modes, trained on a share of the training part.

    Every mode sees the same few rows and is scored on the same 20 % held out.
    """
    parts = splits.split_held_out(items, id_col, seed)
    held_out = stored(parts.where("split = 'val'").select(id_col, image, text, F.col(y_true).alias("y_true")), "val")
    few = stored(
        splits.few_shot_sample(items, id_col, fraction, seed).select(image, text, F.col(y_true).alias("y_true")), "few"
    )
    modes = probe.modalities(image, text)
    results = probe.probe_modes(few, held_out, modes, "y_true", [], "sigmoid", n_classes, cut, passes)
    return metrics.mode_comparison(results, "mode", scoring.MODES)

"""Metric, loss and epoch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.operators import metrics as mt
from loomset.operators.scoring import MODES, by_mode
from loomset.operators.splits import shuffle_batches
from registry import query
from registry.fixtures import epochs, label_predictions, nearest_prototype, prototype_scores, r6, table
from registry.scoring import zero_shot
from registry.sql import CELLS, COMPARISON, EPOCHS, NEAREST, SCORES, SCORES4, hash_order



def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query(
    "confusion_matrix",
    f"""WITH {NEAREST}, seen AS (SELECT y_true AS k FROM nearest UNION SELECT y_pred FROM nearest)
    SELECT t.k AS y_true, p.k AS y_pred, count(n.vec_id) AS n
    FROM seen t CROSS JOIN seen p LEFT JOIN nearest n ON n.y_true = t.k AND n.y_pred = p.k GROUP BY t.k, p.k""",
)
def confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(nearest_prototype(spark, sf_dir), "y_true", "y_pred")


PER_CLASS = f"""{NEAREST}, seen AS (SELECT y_true AS k FROM nearest UNION SELECT y_pred FROM nearest),
per_class AS (
  SELECT k AS label, count(*) FILTER (y_true = k AND y_pred = k) AS tp,
         count(*) FILTER (y_true <> k AND y_pred = k) AS fp, count(*) FILTER (y_true = k AND y_pred <> k) AS fn
  FROM seen CROSS JOIN nearest GROUP BY k)"""


@query("errors_per_class", f"WITH {PER_CLASS} SELECT label, fn, fp FROM per_class")
def errors_per_class(spark, sf_dir):
    return mt.errors_per_class(nearest_prototype(spark, sf_dir), "y_true", "y_pred")


@query(
    "accuracy",
    f"WITH {NEAREST} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 6) AS accuracy FROM nearest",
)
def accuracy(spark, sf_dir):
    return rounded(mt.accuracy(nearest_prototype(spark, sf_dir), "y_true", "y_pred"), "accuracy")


@query(
    "f1_micro",
    f"WITH {PER_CLASS} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM per_class",
)
def f1_micro(spark, sf_dir):
    scores = mt.single_label_f1(nearest_prototype(spark, sf_dir), "y_true", "y_pred")
    return rounded(scores, "f1_micro").select("f1_micro")


@query(
    "f1_macro",
    f"""WITH {PER_CLASS}
    SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS f1_macro FROM per_class""",
)
def f1_macro(spark, sf_dir):
    scores = mt.single_label_f1(nearest_prototype(spark, sf_dir), "y_true", "y_pred")
    return rounded(scores, "f1_macro").select("f1_macro")


@query(
    "multilabel_f1_micro",
    f"WITH {CELLS} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM class_cells",
)
def multilabel_f1_micro(spark, sf_dir):
    return rounded(mt.micro_f1(label_predictions(spark, sf_dir)[0]), "micro_f1")


@query(
    "multilabel_f1_macro",
    f"""WITH {CELLS}
    SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM class_cells""",
)
def multilabel_f1_macro(spark, sf_dir):
    return rounded(mt.macro_f1(label_predictions(spark, sf_dir)[0]), "macro_f1")


@query(
    "subset_accuracy",
    f"""WITH {CELLS}, same AS (SELECT o_orderkey, min(CASE WHEN t = p THEN 1 ELSE 0 END) AS s FROM cells GROUP BY o_orderkey)
    SELECT round(avg(s), 6) AS subset_acc FROM same""",
)
def subset_accuracy(spark, sf_dir):
    return rounded(mt.subset_accuracy(label_predictions(spark, sf_dir)[0]), "subset_acc")


@query(
    "hamming_accuracy",
    f"WITH {CELLS} SELECT round(avg(CASE WHEN t = p THEN 1 ELSE 0 END), 6) AS hamming_acc FROM cells",
)
def hamming_accuracy(spark, sf_dir):
    return rounded(mt.hamming_accuracy(label_predictions(spark, sf_dir)[0]), "hamming_acc")


@query(
    "classification_report",
    f"""WITH {CELLS},
    c AS (SELECT brand AS label, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
                 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f, tp + fn AS s FROM class_cells),
    per_row AS (SELECT o_orderkey, sum(t * p) AS tp, sum(p) AS np, sum(t) AS nt FROM cells GROUP BY o_orderkey),
    report AS (
      SELECT label, p, r, f, s FROM c
      UNION ALL SELECT 'micro avg', sum(tp) / (sum(tp) + sum(fp)), sum(tp) / (sum(tp) + sum(fn)),
        2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), sum(tp) + sum(fn) FROM class_cells
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM c
      UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM c
      UNION ALL SELECT 'samples avg', avg(coalesce(tp / nullif(np, 0), 0)), avg(coalesce(tp / nullif(nt, 0), 0)),
        avg(coalesce(2 * tp / nullif(np + nt, 0), 0)), sum(nt) FROM per_row)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support
    FROM report""",
)
def classification_report(spark, sf_dir):
    predictions, classes = label_predictions(spark, sf_dir)
    return rounded(mt.classification_report(predictions, classes), "precision", "recall", "f1")


@query(
    "bce_loss",
    f"""WITH {CELLS},
    placed AS (SELECT o_orderkey, (row_number() OVER (ORDER BY {hash_order('o_orderkey')}) - 1) // 16 AS batch_id FROM orders),
    loss AS (SELECT o_orderkey, avg(greatest(logit, 0) - logit * t + ln(1 + exp(-abs(logit)))) AS l FROM cells GROUP BY o_orderkey),
    batches AS (SELECT batch_id, avg(l) AS m FROM loss JOIN placed USING (o_orderkey) GROUP BY batch_id)
    SELECT round((SELECT avg(l) FROM loss), 6) AS row_mean, round(avg(m), 6) AS batch_mean FROM batches""",
)
def bce_loss(spark, sf_dir):
    losses = mt.bce_rows(label_predictions(spark, sf_dir)[0]).select("o_orderkey", "loss")
    return rounded(mt.batch_means(shuffle_batches(losses, "o_orderkey", 16), "batch_id"), "row_mean", "batch_mean")


@query(
    "cross_entropy_loss",
    f"""WITH {SCORES},
    sums AS (SELECT vec_id, label, ln(sum(exp(s))) AS z, max(CASE WHEN c = label THEN s END) AS own FROM scores GROUP BY vec_id, label)
    SELECT vec_id, round(z - own, 6) + 0.0 AS loss, round(avg(z - own) OVER (), 6) AS mean_loss FROM sums""",
)
def cross_entropy_loss(spark, sf_dir):
    scored = prototype_scores(spark, sf_dir)
    mean = mt.cross_entropy_loss(scored, "scores", "label").scalar()
    rows = mt.cross_entropy_rows(scored, "scores", "label")
    return rows.select("vec_id", r6("loss").alias("loss"), F.round(mean, 6).alias("mean_loss"))


@query(
    "best_epoch",
    f"""WITH {EPOCHS} SELECT run, epoch, score, seconds FROM epochs WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) = 1""",
)
def best_epoch(spark, sf_dir):
    return mt.best_epoch(epochs(spark, sf_dir), "run", "epoch", "score")


@query("epoch_time_mean", f"WITH {EPOCHS} SELECT run, round(avg(seconds), 6) AS mean_seconds FROM epochs GROUP BY run")
def epoch_time_mean(spark, sf_dir):
    return rounded(mt.epoch_time_mean(epochs(spark, sf_dir), "run", "seconds"), "mean_seconds")


@query(
    "epoch_loss_mean",
    "SELECT user_id AS run, CAST(day(ts) AS INTEGER) AS epoch, round(avg(value), 6) AS mean_loss FROM events GROUP BY 1, 2",
)
def epoch_loss_mean(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch"), "value"
    )
    return rounded(mt.epoch_loss_mean(losses, "run", "epoch", "value"), "mean_loss")


def compared(spark, sf_dir):
    """Scores of the three zero-shot modes against the one-label truth of every vector."""
    rows = by_mode(zero_shot(spark, sf_dir), ["vec_id", "label"])
    truth = F.transform("y_pred", lambda _, i: (i == F.col("label")).cast("int"))
    return mt.mode_comparison(rows.withColumn("y_true", truth), "mode", MODES)


@query(
    "mode_comparison",
    f"WITH {COMPARISON} SELECT mode, " + ", ".join(f"round({s}, 6) AS {s}" for s in SCORES4) + " FROM comparison",
)
def mode_comparison(spark, sf_dir):
    return rounded(compared(spark, sf_dir), *SCORES4)

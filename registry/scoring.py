"""Scoring, probe and batch-hook queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomset.operators import probe as pb
from loomset.operators import scoring as sc
from loomset.operators.splits import split_held_out
from loomset.sources.storage import stored
from loomset.workflows import few_shot_experiment
from registry import query
from registry.fixtures import LOGIT_SCALE, halves, prototype_scores, prototypes, r6, table
from registry.sql import FEW_SHOT, MODE_SCORES, PROBE, PROTOTYPES, SCORES, SCORES4, ZERO_SHOT


@query("zero_shot_logits", f"WITH {SCORES} SELECT vec_id, c AS class, round(s, 6) + 0.0 AS logit FROM scores")
def zero_shot_logits(spark, sf_dir):
    scored = prototype_scores(spark, sf_dir)
    names = sc.class_names(scored, "label")
    return sc.long_scores(scored, ["vec_id"], names, {"scores": "logit"}).withColumn("logit", r6("logit"))


def zero_shot(spark, sf_dir):
    rows = halves(spark, sf_dir)
    return sc.zero_shot_predict(
        rows, "vec_id", "image", "text", prototypes(rows, "image"), prototypes(rows, "text"), "label", "w", LOGIT_SCALE
    )


@query(
    "zero_shot_predict",
    f"WITH {ZERO_SHOT} SELECT vec_id, mode, c AS class, round(prob, 6) AS prob, p AS pred FROM predicted",
)
def zero_shot_predict(spark, sf_dir):
    modes = sc.by_mode(zero_shot(spark, sf_dir), ["vec_id"])
    names = sc.class_names(table(spark, sf_dir, "embeddings"), "label")
    long = sc.long_scores(modes, ["vec_id", "mode"], names, {"probs": "prob", "y_pred": "pred"})
    return long.withColumn("prob", r6("prob"))


@query(
    "linear_head_scores",
    f"""WITH {PROTOTYPES}
    SELECT vec_id, c AS class, round(sum(v * w) + 0.01 * c, 6) + 0.0 AS logit
    FROM entries JOIN proto USING (pos) GROUP BY vec_id, c""",
)
def linear_head_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    heads = prototypes(rows, "embedding").withColumn("b", F.col("label") * F.lit(0.01))
    scored = sc.linear_head_scores(rows, "vec_id", "embedding", heads, "label", "w", "b")
    names = sc.class_names(rows, "label")
    return sc.long_scores(scored, ["vec_id"], names, {"logits": "logit"}).withColumn("logit", r6("logit"))


@query(
    "linear_probe",
    f"""WITH {PROBE}
    SELECT mode, count(*) AS n_rows, round(avg(t), 6) AS accuracy FROM (
      SELECT mode, t FROM scored QUALIFY row_number() OVER (PARTITION BY mode, vec_id ORDER BY z DESC, c) = 1) GROUP BY mode""",
)
def linear_probe(spark, sf_dir):
    """Three probes on the 80 % part, scored on the rest."""
    parts = stored(split_held_out(halves(spark, sf_dir), "vec_id"), "split-vectors")
    predicted = pb.linear_probe(
        parts.where("split = 'train'"), parts.where("split = 'val'"), "image", "text", "label", ["vec_id"]
    )
    rows = predicted.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg((F.col("label") == F.col("y_pred")).cast("int")).alias("accuracy")
    )
    return rows.withColumn("accuracy", r6("accuracy"))


@query(
    "linear_probe_multilabel",
    f"WITH {FEW_SHOT}, {MODE_SCORES} SELECT mode, " + ", ".join(f"round({s}, 6) AS {s}" for s in SCORES4) + " FROM comparison",
)
def linear_probe_multilabel(spark, sf_dir):
    """Few-shot probes with two classes a row: the one of the vector and the last digit of its id."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: ((c == F.col("label")) | (c == F.col("vec_id") % 10)).cast("int"))
    rows = halves(spark, sf_dir).withColumn("y", hot)
    scores = few_shot_experiment(rows, "vec_id", "image", "text", "y", 10)
    return scores.select("mode", *[r6(s).alias(s) for s in SCORES4])


@query(
    "model_batch_scores",
    f"""WITH {PROTOTYPES}
    SELECT vec_id, c AS class, round(sum(v * w) + 0.01 * c, 6) + 0.0 AS logit
    FROM entries JOIN proto USING (pos) GROUP BY vec_id, c""",
)
def model_batch_scores(spark, sf_dir):
    """The same heads as ``linear_head_scores``, as a model that each worker loads once."""
    rows = table(spark, sf_dir, "embeddings")
    heads = prototypes(rows, "embedding").orderBy("label").toPandas()
    load = sc.linear_head_model(np.array(heads["w"].tolist()), heads["label"].to_numpy() * 0.01)
    scored = sc.model_scores(rows, "embedding", load, 64, "logits")
    names = sc.class_names(rows, "label")
    return sc.long_scores(scored, ["vec_id"], names, {"logits": "logit"}).withColumn("logit", r6("logit"))


@query(
    "map_batches_udf",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
)
def map_batches_udf(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")

    def net(batch):
        value = batch["l_extendedprice"] * (1 - batch["l_discount"])
        return batch[["l_orderkey", "l_linenumber"]].assign(net=value)

    mapped = sc.map_batches(rows, net, "l_orderkey BIGINT, l_linenumber INT, net DOUBLE")
    return mapped.withColumn("net", F.round("net", 4))

"""Counts, histograms, quantiles and dense-vector statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.functions import vectors as vx
from loomset.operators import dense as dn
from loomset.operators import stats as st
from loomset.operators.splits import split_train_val
from loomset.plans.quantiles import exact_quantile
from registry import query
from registry.fixtures import CLASS_NAMES, halves, pixels, r6, table, word_counts
from registry.sql import ENTRIES, PROTOTYPES, WORD_COUNT, hash_order

LINES = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem"
COUNTS = f"counts AS (SELECT CAST({WORD_COUNT} AS DOUBLE) AS x FROM documents)"


@query(
    "quantile_outlier_filter",
    f"{LINES} WHERE l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem)",
)
def quantile_outlier_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return st.quantile_outlier_filter(rows, "l_extendedprice")


@query(
    "max_scaled_proxy",
    "SELECT p_partkey, round(p_size / (SELECT CAST(max(p_size) AS DOUBLE) FROM part) * 255, 6) AS scaled FROM part",
)
def max_scaled_proxy(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return st.max_scaled(parts, "p_size").select("p_partkey", r6("scaled").alias("scaled"))


@query("class_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def class_distribution(spark, sf_dir):
    return st.class_distribution(table(spark, sf_dir, "documents"), "lang")


@query(
    "class_distribution_by_split",
    f"""WITH placed AS (
      SELECT label, CASE WHEN row_number() OVER (ORDER BY {hash_order('vec_id')})
        <= floor(0.9 * (SELECT count(*) FROM embeddings)) THEN 'train' ELSE 'val' END AS split FROM embeddings)
    SELECT split, label, count(*) AS n, CASE label """
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in CLASS_NAMES.items())
    + " END AS class_name FROM placed GROUP BY split, label",
)
def class_distribution_by_split(spark, sf_dir):
    rows = split_train_val(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return st.class_distribution_by_split(rows, "split", "label", CLASS_NAMES)


def _bins(low: str, high: str) -> str:
    """SQL of 50 equal bins over [low, high] of ``counts.x``, edges settled by comparison."""
    return f"""ends AS (SELECT {low} AS lo, {high} AS hi FROM counts),
    guess AS (
      SELECT x, lo, (hi - lo) / 50 AS step, least(floor((x - lo) * (50.0::DOUBLE / (hi - lo))), 49) AS g
      FROM counts, ends WHERE x BETWEEN lo AND hi),
    placed AS (
      SELECT CAST(g - CASE WHEN x < lo + g * step THEN 1 ELSE 0 END
             + CASE WHEN x >= lo + (g + 1) * step AND g < 49 THEN 1 ELSE 0 END AS INTEGER) AS bin FROM guess),
    hist AS (SELECT bin, count(*) AS n FROM placed GROUP BY bin)"""


HISTOGRAM = """SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 50), 6) AS bin_start,
      round(lo + (i + 1) * ((hi - lo) / 50), 6) AS bin_end, coalesce(n, 0) AS n
    FROM range(50) r(i) CROSS JOIN ends LEFT JOIN hist ON bin = i"""


def _rounded(hist):
    return hist.select("bin", r6("bin_start").alias("bin_start"), r6("bin_end").alias("bin_end"), "n")


@query("word_count_histogram", f"WITH {COUNTS}, {_bins('0.0::DOUBLE', 'quantile_cont(x, 0.99)')} {HISTOGRAM}")
def word_count_histogram(spark, sf_dir):
    return _rounded(st.quantile_histogram(word_counts(spark, sf_dir), "word_count"))


@query("auto_histogram", f"WITH {COUNTS}, {_bins('min(x)', 'max(x)')} {HISTOGRAM}")
def auto_histogram(spark, sf_dir):
    return _rounded(st.auto_histogram(word_counts(spark, sf_dir), "word_count"))


@query(
    "kde_curve",
    f"""WITH {COUNTS},
    shape AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi FROM counts),
    curve AS (
      SELECT i, lo + i * (hi - lo) / 199 AS place, sum(exp(-0.5 * pow((lo + i * (hi - lo) / 199 - x) / h, 2))) AS mass
      FROM counts CROSS JOIN range(200) r(i) CROSS JOIN shape GROUP BY i, lo, hi)
    SELECT CAST(i AS INTEGER) AS point, round(place, 6) AS x, round(mass / (n * h * sqrt(2 * pi())), 9) AS density,
           round(mass / (h * sqrt(2 * pi())) * (hi - lo) / 50, 6) AS scaled
    FROM curve CROSS JOIN shape""",
)
def kde_curve(spark, sf_dir):
    curve = st.kde_curve(word_counts(spark, sf_dir), "word_count")
    return curve.select(
        "point", r6("x").alias("x"), F.round("density", 9).alias("density"), r6("scaled").alias("scaled")
    )


QUANTILES = [0.25, 0.5, 0.95, 0.99]


@query(
    "quantile",
    " UNION ALL ".join(
        f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(n_chars, {q}), 6) AS quantile FROM documents"
        for q in QUANTILES
    ),
)
def quantile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("n_chars")
    answers = F.array(
        *[F.struct(F.lit(q).alias("q"), exact_quantile(docs, "n_chars", q).scalar().alias("v")) for q in QUANTILES]
    )
    return spark.range(1).select(F.inline(answers)).select("q", r6("v").alias("quantile"))


PIXELS = f"""{ENTRIES},
px AS (SELECT label, CAST((pos - 1) % 3 AS INTEGER) AS channel, CAST(floor((v + 1.0) * 127.5) AS INTEGER) AS value
       FROM entries)"""


@query(
    "pixel_histogram",
    f"""WITH {PIXELS}, counts AS (SELECT channel, value, count(*) AS n FROM px GROUP BY channel, value)
    SELECT CAST(c AS INTEGER) AS channel, CAST(v AS INTEGER) AS value, coalesce(n, 0) AS n
    FROM range(3) a(c) CROSS JOIN range(256) b(v) LEFT JOIN counts ON channel = c AND value = v""",
)
def pixel_histogram(spark, sf_dir):
    return dn.pixel_histogram(pixels(spark, sf_dir), "pixels")


@query("channel_means", f"WITH {PIXELS} SELECT channel, round(avg(value), 6) AS mean FROM px GROUP BY channel")
def channel_means(spark, sf_dir):
    means = dn.channel_means(pixels(spark, sf_dir), "pixels")
    return means.select(F.col("channel").cast("int").alias("channel"), r6("mean").alias("mean"))


@query(
    "class_mean_vector",
    f"""WITH {PROTOTYPES}
    SELECT c AS label, CAST(pos - 1 AS INTEGER) AS pos, round(w, 6) + 0.0 AS value FROM proto""",
)
def class_mean_vector(spark, sf_dir):
    means = dn.class_mean_vector(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return dn.vector_entries(means, "label", "vector").withColumn("value", r6("value"))


@query(
    "class_similarity_vectors",
    f"""WITH {PROTOTYPES}
    SELECT x.c AS a, y.c AS b,
      round(sum(x.w * y.w) / (sqrt(sum(x.w * x.w)) * sqrt(sum(y.w * y.w))), 6) + 0.0 AS similarity
    FROM proto x JOIN proto y ON x.pos = y.pos GROUP BY x.c, y.c""",
)
def class_similarity_vectors(spark, sf_dir):
    means = dn.class_mean_vector(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return dn.class_similarity(means, "label").withColumn("similarity", r6("similarity"))


@query(
    "cosine",
    f"""WITH {ENTRIES}
    SELECT x.vec_id, round(sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v))), 6) + 0.0 AS cosine
    FROM entries x JOIN entries y ON x.vec_id = y.vec_id AND y.pos = x.pos + 32 GROUP BY x.vec_id""",
)
def cosine(spark, sf_dir):
    return halves(spark, sf_dir).select("vec_id", r6(vx.cosine(F.col("image"), F.col("text"))).alias("cosine"))


@query(
    "softmax",
    f"""WITH {ENTRIES}
    SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos,
           round(exp(10 * v) / sum(exp(10 * v)) OVER (PARTITION BY vec_id), 6) AS p FROM entries""",
)
def softmax(spark, sf_dir):
    scaled = F.transform(vx.as_doubles(F.col("embedding")), lambda x: x * 10)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vx.softmax(scaled)).alias("pos", "p"))
    return rows.withColumn("p", r6("p"))


@query(
    "sigmoid",
    f"""WITH {ENTRIES}
    SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(1 / (1 + exp(-10 * v)), 6) AS p FROM entries""",
)
def sigmoid(spark, sf_dir):
    scaled = F.transform(vx.as_doubles(F.col("embedding")), lambda x: vx.sigmoid(x * 10))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scaled).alias("pos", "p"))
    return rows.withColumn("p", r6("p"))


@query(
    "fuse_concat",
    f"""WITH {ENTRIES}
    SELECT vec_id, CAST((pos + 31) % 64 AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM entries""",
)
def fuse_concat(spark, sf_dir):
    rows = halves(spark, sf_dir).select("vec_id", vx.fuse_concat(F.col("text"), F.col("image")).alias("v"))
    return dn.vector_entries(rows, "vec_id", "v").withColumn("value", r6(F.col("value").cast("double")))


@query(
    "fuse_mean",
    f"""WITH {ENTRIES}
    SELECT x.vec_id, CAST(x.pos - 1 AS INTEGER) AS pos, round((x.v + y.v) / 2, 6) + 0.0 AS value
    FROM entries x JOIN entries y ON x.vec_id = y.vec_id AND y.pos = x.pos + 32""",
)
def fuse_mean(spark, sf_dir):
    mean = vx.fuse_mean(vx.as_doubles(F.col("image")), vx.as_doubles(F.col("text")))
    rows = halves(spark, sf_dir).select("vec_id", mean.alias("v"))
    return dn.vector_entries(rows, "vec_id", "v").withColumn("value", r6("value"))

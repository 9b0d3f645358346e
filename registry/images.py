"""Image queries on small images drawn from the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.operators import images as im
from loomset.operators import pixels as px
from loomset.operators import stats as st
from loomset.sources import images as src
from loomset.sources.storage import shared_dir, stored
from registry import query
from registry.fixtures import color_images, gray_images, png_store, r6, table
from registry.sql import ENTRIES, GRAY

# length of an uncompressed gray PNG: 57 bytes of frame, 11 of stream, rows of width + 1
KB = "(68 + 64 + 64 // width) / 1024.0"
NAME = "printf('img_%06d.png', vec_id)"


def _rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query(
    "image_scan",
    f"""SELECT {NAME} AS file_name,
      CASE WHEN label <> 8 THEN CAST(width AS INTEGER) END AS width, CASE WHEN label <> 8 THEN CAST(64 // width AS INTEGER) END AS height,
      CASE WHEN label <> 8 THEN 'L' END AS color_mode, CASE WHEN label <> 8 THEN round({KB}, 6) END AS file_size_kb
    FROM (SELECT vec_id, label, 4 << (label % 3) AS width FROM embeddings)""",
)
def image_scan(spark, sf_dir):
    """PNG files, of which class 8 cannot be read."""
    scanned = src.scan_images(spark, png_store(spark, sf_dir))
    return _rounded(scanned, "file_size_kb").select("file_name", "width", "height", "color_mode", "file_size_kb")


QUALITY = "round(sharpness, 6) AS sharpness, round(contrast, 6) AS contrast, round(gray_avg, 6) AS r_avg, round(gray_avg, 6) AS g_avg"


@query(
    "metadata_align",
    f"""WITH {GRAY}
    SELECT vec_id, CAST(width AS INTEGER) AS width, round(width * width / 64.0, 6) AS aspect_ratio, round({KB}, 6) AS file_size_kb, {QUALITY}
    FROM quality WHERE label <> 8""",
)
def metadata_align(spark, sf_dir):
    """Every vector row beside its PNG file; keys without a readable file fall out."""
    measures = im.image_quality(src.scan_images(spark, png_store(spark, sf_dir)))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.explode(F.array(*[F.format_string(f"{x}_%06d.png", F.col("vec_id")) for x in ("img", "gone")])).alias("image_key"),
    )
    aligned = im.metadata_align(rows, measures, "image_key")
    names = ["aspect_ratio", "file_size_kb", "sharpness", "contrast", "r_avg", "g_avg"]
    return _rounded(aligned, *names).select("vec_id", "width", *names)


@query("image_quality", f"WITH {GRAY} SELECT vec_id, CAST(width AS INTEGER) AS width, {QUALITY} FROM quality")
def image_quality(spark, sf_dir):
    measures = im.image_quality(gray_images(spark, sf_dir))
    rounded = _rounded(measures, "sharpness", "contrast", "r_avg", "g_avg")
    return rounded.select(F.col("path").cast("bigint").alias("vec_id"), "width", "sharpness", "contrast", "r_avg", "g_avg")


@query(
    "image_size_pairs",
    "SELECT CAST(4 << (label % 3) AS INTEGER) AS width, CAST(64 // (4 << (label % 3)) AS INTEGER) AS height, count(*) AS n FROM embeddings GROUP BY label % 3",
)
def image_size_pairs(spark, sf_dir):
    return im.image_size_pairs(gray_images(spark, sf_dir))


@query(
    "sharpness_contrast_filtered",
    f"""WITH {GRAY} SELECT vec_id, round(sharpness, 6) AS sharpness, round(contrast, 6) AS contrast FROM quality
    WHERE sharpness < (SELECT quantile_cont(sharpness, 0.95) FROM quality)""",
)
def sharpness_contrast_filtered(spark, sf_dir):
    measures = stored(im.image_quality(gray_images(spark, sf_dir)), "quality")
    kept = im.sharpness_contrast_filtered(measures)
    return _rounded(kept, "sharpness", "contrast").select(
        F.col("path").cast("bigint").alias("vec_id"), "sharpness", "contrast"
    )


@query(
    "rgb_proxy",
    f"""WITH {GRAY} SELECT vec_id, round(gray_avg, 6) AS r_avg, round(gray_avg, 6) AS g_avg,
      round(width / (SELECT CAST(max(width) AS DOUBLE) FROM quality) * 255, 6) AS blue_proxy FROM quality""",
)
def rgb_proxy(spark, sf_dir):
    proxy = im.rgb_proxy(im.image_quality(gray_images(spark, sf_dir)))
    return _rounded(proxy, "r_avg", "g_avg", "blue_proxy").select(
        F.col("path").cast("bigint").alias("vec_id"), "r_avg", "g_avg", "blue_proxy"
    )


def _stored(pages):
    """Pages served over https stand for images that are already there."""
    return pages.where(F.col("url").startswith("https:"))


@query(
    "image_lookup_fallback",
    """SELECT page_id, url NOT LIKE 'https:%' AS is_fallback,
      CAST(CASE WHEN url LIKE 'https:%' THEN octet_length(encode(html)) ELSE 150528 END AS INTEGER) AS n_bytes FROM pages""",
)
def image_lookup_fallback(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    images = _stored(pages).select("page_id", F.col("html").cast("binary").alias("data"))
    found = src.lookup_with_fallback(pages.select("page_id"), images, "page_id")
    return found.select("page_id", "is_fallback", F.octet_length("data").alias("n_bytes"))


@query(
    "image_materialize_missing",
    """SELECT printf('movie_%05d.jpg', row_number() OVER (ORDER BY page_id) - 1) AS image_key,
      md5(html) AS content, count(*) OVER () AS n_stored FROM pages""",
)
def image_materialize_missing(spark, sf_dir):
    """Store the pages over https first, then what is missing, then again to no effect."""
    pages = table(spark, sf_dir, "pages")
    images = F.array(F.col("html").cast("binary"))
    keyed = src.numbered_images(pages, ["page_id"]).withColumn("data", src.first_image(images))
    store = shared_dir(spark, "image-store")
    _stored(keyed).select("image_key", "data").write.parquet(store)
    src.materialize_missing(keyed, store, "image_key", "data")
    stored = src.materialize_missing(keyed, store, "image_key", "data")
    total = stored.agg(F.count(F.lit(1))).scalar()
    return stored.select("image_key", F.md5("data").alias("content"), total.alias("n_stored"))


# the value of each pixel and channel of the files: gray, RGB (63 values), RGBA (alpha is not counted)
FILE_PIXELS = f"""{ENTRIES},
file_values AS (
  SELECT label, label % 3 AS kind, pos - 1 AS i, CAST(floor((v + 1.0) * 127.5) AS INTEGER) AS value FROM entries WHERE label <> 8),
file_pixels AS (
  SELECT label, i AS pixel, unnest(range(3)) AS channel, value FROM file_values WHERE kind = 0
  UNION ALL SELECT label, i // 3, i % 3, value FROM file_values WHERE kind = 1 AND i < 63
  UNION ALL SELECT label, i // 4, i % 4, value FROM file_values WHERE kind = 2 AND i % 4 < 3)"""


def scanned(spark, sf_dir):
    return src.scan_images(spark, png_store(spark, sf_dir, color_images(spark, sf_dir)))


@query(
    "pixel_histogram_files",
    f"""WITH {FILE_PIXELS}, counts AS (SELECT channel, value, count(*) AS n FROM file_pixels GROUP BY channel, value)
    SELECT CAST(c AS INTEGER) AS channel, CAST(v AS INTEGER) AS value, coalesce(n, 0) AS n
    FROM range(3) a(c) CROSS JOIN range(256) b(v) LEFT JOIN counts ON channel = c AND value = v""",
)
def pixel_histogram_files(spark, sf_dir):
    """Counts of the bytes of PNG files in gray, RGB and RGBA."""
    return px.pixel_counts(scanned(spark, sf_dir))


@query(
    "channel_means_files",
    f"WITH {FILE_PIXELS} SELECT CAST(channel AS INTEGER) AS channel, round(avg(value), 6) AS mean FROM file_pixels GROUP BY channel",
)
def channel_means_files(spark, sf_dir):
    return px.counted_channel_means(px.pixel_counts(scanned(spark, sf_dir))).withColumn("mean", r6("mean"))


@query(
    "class_mean_image",
    f"""WITH {FILE_PIXELS}
    SELECT label, CAST(pixel * 3 + channel AS INTEGER) AS pos, count(*) AS n, round(avg(value), 6) AS value
    FROM file_pixels GROUP BY label, pixel, channel""",
)
def class_mean_image(spark, sf_dir):
    """The mean of the files of each class; the label comes from the table, by file name."""
    labels = table(spark, sf_dir, "embeddings").select(F.format_string("img_%06d.png", "vec_id").alias("file_name"), "label")
    rows = scanned(spark, sf_dir).join(labels, "file_name")
    means = px.class_mean_image(rows, F.col("label"))
    return means.select("label", "n", F.posexplode("vector").alias("pos", "value")).withColumn("value", r6("value"))


# the value of both measures of a file, and its bins
MEASURES = f"""measures AS (
  SELECT 'aspect_ratio' AS measure, width * width / 64.0::DOUBLE AS x FROM (SELECT label, 4 << (label % 3) AS width FROM embeddings) WHERE label <> 8
  UNION ALL SELECT 'file_size_kb', ({KB})::DOUBLE FROM (SELECT label, 4 << (label % 3) AS width FROM embeddings) WHERE label <> 8)"""


@query(
    "image_measure_histograms",
    f"""WITH {MEASURES},
    ends AS (SELECT measure, min(x) AS lo, max(x) AS hi FROM measures GROUP BY measure),
    guess AS (SELECT measure, x, lo, (hi - lo) / 50 AS step, least(floor((x - lo) * (50.0::DOUBLE / (hi - lo))), 49) AS g
              FROM measures JOIN ends USING (measure)),
    placed AS (SELECT measure, CAST(g - CASE WHEN x < lo + g * step THEN 1 ELSE 0 END
      + CASE WHEN x >= lo + (g + 1) * step AND g < 49 THEN 1 ELSE 0 END AS INTEGER) AS bin FROM guess),
    hist AS (SELECT measure, bin, count(*) AS n FROM placed GROUP BY measure, bin)
    SELECT ends.measure, CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 50), 6) AS bin_start, coalesce(n, 0) AS n
    FROM ends CROSS JOIN range(50) r(i) LEFT JOIN hist ON hist.measure = ends.measure AND hist.bin = i""",
)
def image_measure_histograms(spark, sf_dir):
    """Histograms of aspect ratio and file size; unreadable files have nulls, which are left out."""
    files = stored(src.scan_images(spark, png_store(spark, sf_dir)).drop("data"), "files")
    rows = files.select((F.col("width") / F.col("height")).alias("aspect_ratio"), "file_size_kb")
    parts = [st.auto_histogram(rows, m).select(F.lit(m).alias("measure"), "bin", r6("bin_start").alias("bin_start"), "n") for m in rows.columns]
    return parts[0].unionByName(parts[1])

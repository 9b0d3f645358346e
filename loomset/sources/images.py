"""Image files and image tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.plans.ranking import global_index
from loomset.plans.sizes import broadcast_if
from loomset.sources.late_fetch import FILE, ROW, fetch, with_places

# Spark's channel counts and the colour mode each one stands for.
COLOR_MODES = {1: "L", 3: "RGB", 4: "RGBA"}


def image_key(position: Column) -> Column:
    return F.format_string("movie_%05d.jpg", position)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, file_name, width, height, channels, color_mode, file_size_kb, data)``.

    A file that is no image keeps its row with null columns. The file length comes
    from the scan itself, so the image bytes are not shuffled into a join.
    ``data`` holds the pixels in Spark's order: row by row, blue first.
    """
    raw = spark.read.format("image").load(path).select(
        "image.*", (F.col("_metadata.file_size") / F.lit(1024.0)).alias("kb")
    )
    ok = F.col("height") > 0
    modes = F.create_map(*[F.lit(x) for pair in COLOR_MODES.items() for x in pair])

    def valid(column: Column) -> Column:
        return F.when(ok, column)

    return raw.select(
        F.col("origin").alias("path"),
        file_name(F.col("origin")).alias("file_name"),
        valid(F.col("width")).alias("width"),
        valid(F.col("height")).alias("height"),
        valid(F.col("nChannels")).alias("channels"),
        valid(F.try_element_at(modes, F.col("nChannels"))).alias("color_mode"),
        valid(F.col("kb")).alias("file_size_kb"),
        valid(F.col("data")).alias("data"),
    )


def first_image(images: Column) -> Column:
    """First of a list of images; null for an empty list."""
    return F.try_element_at(images, F.lit(1))


MAX_BROADCAST_KEYS = 1_000_000


def missing_images(source: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Source rows whose key is not stored yet."""
    return source.join(stored.select(key), key, "left_anti")


def _chosen(images: DataFrame, keys: DataFrame, key: str, data: str, few: bool) -> DataFrame:
    """``(key, file, row)``: the place of one image for each of the keys.

    Of images that share a key, it is the one with the smallest digest, then the first in the store. Bytes are
    read only where a key repeats, and digests are what the join carries.
    """
    wanted = broadcast_if(few, keys)
    alone = images.select(key, FILE, ROW).join(wanted.where("_n = 1"), key).select(key, FILE, ROW)
    digests = images.select(key, F.sha2(data, 256).alias("_digest"), FILE, ROW)
    first = F.min(F.struct(F.col("_digest").isNull(), "_digest", FILE, ROW)).alias("_first")
    least = digests.join(wanted.where("_n > 1"), key).groupBy(key).agg(first)
    return alone.unionByName(least.select(key, f"_first.{FILE}", f"_first.{ROW}"))


def materialize_missing(source: DataFrame, store_path: str, key: str, data: str) -> DataFrame:
    """Append the images a Parquet store lacks and return the store.

    Running it again adds nothing. Of images with one key, the one with the smallest SHA-256 is
    stored. The missing keys are found by a join of keys alone, and broadcast when they are
    few; the bytes of the chosen images are read by their place after that and are never shuffled.
    """
    spark = source.sparkSession
    images = with_places(source.select(key, data))
    schema = source.select(key, data).schema
    stored = spark.read.schema(schema).parquet(store_path)
    keys = images.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    missing = missing_images(keys, stored, key).persist()
    try:
        n = missing.count()
        if n:
            places = _chosen(images, missing, key, data, n <= MAX_BROADCAST_KEYS)
            fetch(places, images, [data]).write.mode("append").parquet(store_path)
    finally:
        missing.unpersist()
    return spark.read.schema(schema).parquet(store_path)


def lookup_with_fallback(
    rows: DataFrame, images: DataFrame, key: str, data: str = "data", width: int = 224, height: int = 224
) -> DataFrame:
    """Attach each row's image; a missing one becomes a black RGB image.

    Every row stays one row: of images that share a key, the first in the store counts. The join
    carries keys and places; each task then reads the bytes of its rows, so that no
    shuffle holds an image, and a popular one is read once by each task that needs it. The blank is one
    constant of the plan.
    """
    blank = F.lit(bytearray(width * height * 3))
    placed = with_places(images.select(key, data))
    first = placed.groupBy(key).agg(F.min(F.struct(FILE, ROW)).alias("_place"))
    joined = rows.join(first, key, "left").select(*rows.columns, F.col(f"_place.{FILE}"), F.col(f"_place.{ROW}"))
    found = fetch(joined, placed, [data])
    return found.select(
        *rows.columns,
        F.coalesce(data, blank).alias(data),
        F.col(data).isNull().alias("is_fallback"),
    )


def numbered_images(source: DataFrame, order_by: list[str]) -> DataFrame:
    """Add the file key by position in the given order; only the ordering columns are sorted."""
    placed = with_places(source)
    light = global_index(placed.select(*order_by, FILE, ROW), order_by, "_position")
    others = [c for c in source.columns if c not in order_by]
    keyed = light.withColumn("image_key", image_key(F.col("_position"))).drop("_position")
    return fetch(keyed, placed, others).select(*source.columns, "image_key")

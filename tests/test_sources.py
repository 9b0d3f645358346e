"""Files, tables and images."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import images as im
from loomset.sources import images as src
from loomset.sources import metadata as md
from loomset.sources import tables as tb
from loomset.sources.storage import shared_dir
from loomset.sources.word_vectors import read_word_vectors
from registry.fixtures import png_bytes


def test_csv_round_trip(spark):
    rows = [
        (' He said "no", then\nleft; ', "a.jpg", "Drama|Action"),
        ("plain", "b.jpg", "NA"),
        ("None", "c.jpg", ""),
        ('"quoted"', "d.jpg", None),
        ("back\\slash\tand ''", "e.jpg", "null"),
    ]
    path = shared_dir(spark, "csv")
    md.write_metadata_csv(spark.createDataFrame(rows, md.METADATA_SCHEMA).repartition(2), path)
    got = {r["image_path"]: (r["plot"], r["genres"]) for r in md.read_metadata_csv(spark, path).collect()}
    assert got == {
        "a.jpg": (' He said "no", then\nleft; ', "Drama|Action"),
        "b.jpg": ("plain", None),
        "c.jpg": (None, None),
        "d.jpg": ('"quoted"', None),
        "e.jpg": ("back\\slash\tand ''", None),
    }
    raw = {r["image_path"]: r["genres"] for r in md.read_metadata_csv(spark, path, normalise_missing=False).collect()}
    assert raw["b.jpg"] == "NA"


def test_word_vectors_last_line_wins(spark, tmp_path):
    lines = ["cat 1 2", "dog 0.5 -1e-3", "cat 3 4", "  emu\t7   8 ", "", "cat 5 6"]
    (tmp_path / "v.txt").write_text("\n".join(lines) + "\n")
    got = {r["word"]: r["vector"] for r in read_word_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {"cat": [5.0, 6.0], "dog": pytest.approx([0.5, -0.001]), "emu": [7.0, 8.0]}


def test_word_vectors_over_many_splits(spark, tmp_path):
    lines = [f"w{i % 500} {i} {i + 1}" for i in range(20_000)]
    (tmp_path / "v.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = {r["word"]: r["vector"] for r in read_word_vectors(spark, str(tmp_path / "v.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"w{i}": [19_500.0 + i, 19_501.0 + i] for i in range(500)}


def test_split_column_is_pruned(spark):
    path = shared_dir(spark, "split")
    spark.createDataFrame([(1, "train"), (2, "test")], "id INT, split STRING").write.partitionBy("split").parquet(path)
    df = tb.scan_table(spark, path, "id INT, split STRING", split="test")
    assert [tuple(r) for r in df.collect()] == [(2,)]
    assert "PartitionFilters: [isnotnull(split" in df._jdf.queryExecution().executedPlan().toString()


def test_metrics_round_trip(spark):
    path = shared_dir(spark, "metrics")
    tb.write_metrics(spark.createDataFrame([("m", "f1", 0.25)], "mode STRING, metric STRING, value DOUBLE"), path)
    assert tuple(tb.read_metrics(spark, path, "mode STRING, metric STRING, value DOUBLE").first()) == ("m", "f1", 0.25)


def test_drop_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (None, "b", 1)], "x INT, y STRING, z INT")
    assert tb.drop_nulls(df, ["x", "y"]).count() == 1 and tb.record_count(df).first()[0] == 2


# --- images -----------------------------------------------------------------------


def picture(seed, width, height, samples):
    return np.random.default_rng(seed).integers(0, 256, size=(height, width, samples), dtype=np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("png")
    made = {
        "gray.png": (np.full((5, 7, 1), 90, np.uint8), 0),
        "rgb.png": (picture(1, 6, 4, 3), 2),
        "rgba.png": (np.concatenate([picture(2, 3, 5, 3), np.full((5, 3, 1), 255, np.uint8)], axis=2), 6),
        "dot.png": (np.zeros((5, 5, 1), np.uint8), 0),
    }
    made["dot.png"][0][2, 2, 0] = 255
    for name, (pixels, color) in made.items():
        h, w, c = pixels.shape
        (base / name).write_bytes(png_bytes(pixels.tobytes(), w, h, color, c))
    (base / "bad.png").write_bytes(b"not an image")
    return str(base), {k: v[0] for k, v in made.items()}


def laplacian_variance(gray):
    p = np.pad(gray, 1, mode="reflect")
    h, w = gray.shape
    out = [
        p[y, x + 1] + p[y + 2, x + 1] + p[y + 1, x] + p[y + 1, x + 2] - 4 * p[y + 1, x + 1]
        for y in range(h) for x in range(w)
    ]
    return np.var(out)


def test_scan_reports_size_and_mode(spark, folder):
    path, made = folder
    got = {r["file_name"]: r for r in src.scan_images(spark, path).collect()}
    assert len(got) == 5
    assert (got["rgb.png"]["width"], got["rgb.png"]["height"], got["rgb.png"]["color_mode"]) == (6, 4, "RGB")
    assert got["gray.png"]["color_mode"] == "L" and got["rgba.png"]["color_mode"] == "RGBA"
    assert all(got["bad.png"][c] is None for c in ("width", "height", "color_mode", "file_size_kb", "data"))
    assert got["dot.png"]["file_size_kb"] == len(png_bytes(made["dot.png"].tobytes(), 5, 5)) / 1024


def test_quality(spark, folder):
    path, made = folder
    got = {r["file_name"]: r for r in im.image_quality(src.scan_images(spark, path)).collect()}
    assert got["gray.png"]["sharpness"] == 0 and got["gray.png"]["contrast"] == 0 and got["gray.png"]["r_avg"] == 90
    assert got["bad.png"]["sharpness"] is None and got["bad.png"]["aspect_ratio"] is None
    for name in ("rgb.png", "rgba.png", "dot.png"):
        image = made[name].astype(float)
        rgb = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]
        gray = np.floor(rgb @ [0.299, 0.587, 0.114] + 0.5)
        assert got[name]["sharpness"] == pytest.approx(laplacian_variance(gray))
        assert got[name]["contrast"] == pytest.approx(gray.std())
        assert got[name]["r_avg"] == pytest.approx(rgb[..., 0].mean())
        assert got[name]["g_avg"] == pytest.approx(rgb[..., 1].mean())
    assert got["rgb.png"]["aspect_ratio"] == 1.5


def test_size_pairs_and_proxy(spark, folder):
    measures = im.image_quality(src.scan_images(spark, folder[0])).where("width IS NOT NULL")
    pairs = {(r["width"], r["height"]): r["n"] for r in im.image_size_pairs(measures).collect()}
    assert pairs == {(7, 5): 1, (6, 4): 1, (3, 5): 1, (5, 5): 1}
    proxy = {r["file_name"]: r["blue_proxy"] for r in im.rgb_proxy(measures).collect()}
    assert proxy["gray.png"] == 255 and proxy["rgba.png"] == pytest.approx(255 * 3 / 7)


def test_align_by_key(spark, folder):
    measures = im.image_quality(src.scan_images(spark, folder[0]))
    rows = spark.createDataFrame([(1, "rgb.png"), (2, "bad.png"), (3, "gone.png")], "id INT, image_key STRING")
    got = im.metadata_align(rows, measures, "image_key").collect()
    assert [(r["id"], r["width"]) for r in got] == [(1, 6)]


def test_thin_image_mirrors_along_its_length():
    row = np.array([[0.0, 10.0, 40.0]])[:, :, None].repeat(3, axis=2)
    # across: the row repeats and cancels; along: 10+10-0, 0+40-20, 10+10-80
    assert im.quality(row)[0] == pytest.approx(np.var([20.0, 20.0, -60.0]))


def test_shrinking_keeps_the_mean():
    image = np.arange(600 * 300 * 3, dtype=float).reshape(600, 300, 3) % 256
    small = im._shrink(image, 256)
    assert small.shape == (256, 128, 3) and small.mean() == pytest.approx(image.mean(), abs=1)
    odd = im._shrink(np.full((513, 257, 3), 7.0), 256)
    assert odd.shape == (256, 128, 3) and (odd == 7).all()
    assert im._shrink(image, None) is image
    exact = im._shrink(np.arange(12, dtype=float).reshape(2, 6, 1), 3)
    assert exact[0, :, 0].tolist() == [4, 6, 8] or exact[:, :, 0].tolist() == [[4, 6, 8]]
    assert im._shrink(image[:256, :256], 256) is not None and im._shrink(image[:256, :256], 256).shape == (256, 256, 3)


def test_image_measures_have_no_size_step(spark):
    """Noise of 255 to 300 pixels is measured at full size by default, and near the limit alike."""
    noise = np.random.default_rng(1).integers(0, 256, (300, 300), dtype=np.uint8)
    sizes = (255, 256, 257, 300)
    images = spark.createDataFrame(
        [(f"{n}", f"{n}", n, n, 1, "L", 0.0, bytearray(noise[:n, :n].tobytes())) for n in sizes],
        "path STRING, file_name STRING, width INT, height INT, channels INT, color_mode STRING, file_size_kb DOUBLE, data BINARY",
    )
    got = {r["width"]: r for r in im.image_quality(images).collect()}
    for n in sizes:
        want = im.quality(np.repeat(noise[:n, :n, None].astype(float), 3, axis=2))
        assert [got[n][c] for c in ("sharpness", "contrast", "r_avg", "g_avg")] == pytest.approx(want)


def test_a_repeated_key_is_stored_once(spark):
    rows = spark.createDataFrame([("a", b"2"), ("a", b"1"), ("b", b"3")], "key STRING, data BINARY")
    store = shared_dir(spark, "store")
    rows.where("key = 'none'").write.parquet(store)
    got = src.materialize_missing(rows, store, "key", "data").collect()
    assert sorted((r["key"], bytes(r["data"])) for r in got) == [("a", b"1"), ("b", b"3")]


def test_lookup_with_fallback(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, key STRING")
    images = spark.createDataFrame([("a", bytearray(b"xyz"))], "key STRING, data BINARY")
    got = {r["id"]: r for r in src.lookup_with_fallback(rows, images, "key", width=2, height=2).collect()}
    assert bytes(got[1]["data"]) == b"xyz" and not got[1]["is_fallback"]
    assert bytes(got[2]["data"]) == bytes(12) and got[2]["is_fallback"]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_store_is_filled_once(spark, few, monkeypatch):
    monkeypatch.setattr(src, "MAX_BROADCAST_KEYS", few)
    rows = spark.range(20).select(src.image_key(F.col("id")).alias("key"), F.col("id").cast("string").cast("binary").alias("data"))
    store = shared_dir(spark, "store")
    rows.where("key < 'movie_00005'").write.parquet(store)
    assert src.materialize_missing(rows, store, "key", "data").count() == 20
    again = src.materialize_missing(rows, store, "key", "data")
    assert again.count() == 20 and again.select("key").distinct().count() == 20


def test_first_image_and_numbering(spark):
    df = spark.createDataFrame([("b", [b"2"]), ("a", [b"1", b"9"]), ("c", [])], "k STRING, images ARRAY<BINARY>")
    got = src.numbered_images(df, ["k"]).withColumn("one", src.first_image(F.col("images"))).collect()
    assert {r["k"]: (r["image_key"], r["one"] and bytes(r["one"])) for r in got} == {
        "a": ("movie_00000.jpg", b"1"), "b": ("movie_00001.jpg", b"2"), "c": ("movie_00002.jpg", None),
    }

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelsieve import errors as err
from pixelsieve.functions import raster as rs
from pixelsieve.operators import hashers as hh
from pixelsieve.operators import kernel_columns as kc
from pixelsieve.sources import images as src
from pixelsieve.streaming import hashing
from pixelsieve.types import BlockMethod, Feature, Interpolation, Kind, Storage

RASTER = "height int, width int, channels int, pixels array<int>"
RNG = np.random.default_rng(3)


def rasters(spark, *images):
    rows = [(k, None if x is None else (x.shape[0], x.shape[1], 1 if x.ndim == 2 else 3, x.ravel().tolist())) for k, x in enumerate(images)]
    return spark.createDataFrame(rows, f"id long, raster struct<{RASTER.replace(' ', ':').replace(',:', ',')}>")


GRAY, COLOUR = RNG.integers(0, 256, (50, 61)), RNG.integers(0, 256, (33, 40, 3))
LENGTHS = {
    "Average": 8, "Median": 8, "Difference": 8, "PHash": 8, "WHash": 8, "BlockMean": 32, "MarrHildreth": 72, "PDQ": 32, "RASH": 8, "RadialVariance": 40,
    "ColorMoment": 42, "CLD": 12, "EHD": 80, "LBP": 256, "HOG": 9216, "GIST": 320, "Zernike": 24, "BoVW": 256,
}


@pytest.mark.parametrize("name", list(LENGTHS))
def test_defaults(spark, name):
    hasher = hh.HASHERS[name]()
    out = rasters(spark, GRAY, None, COLOUR, GRAY).select(hasher.hash("raster").alias("h")).collect()
    assert [None if r["h"] is None else len(r["h"]) for r in out] == [LENGTHS[name], None, LENGTHS[name], LENGTHS[name]]
    assert out[0] == out[3]
    if hasher.kind != Kind.FLOAT64:
        assert all(0 <= v <= 255 for v in out[0]["h"])
    df = spark.createDataFrame([(out[0]["h"], out[2]["h"])], f"a {hasher.kind.spark_type}, b {hasher.kind.spark_type}")
    d = df.select(hasher.distance("a", "b").alias("d"), hasher.distance("a", "a").alias("z")).first()
    assert abs(d["z"]) < 1e-12 and d["d"] >= 0


@pytest.mark.parametrize(
    "hasher,n",
    [
        (hh.Average(width=3, height=3), 2), (hh.Median(width=3, height=3), 2), (hh.Difference(width=3, height=3), 2), (hh.WHash(width=3, height=3, level=1), 2), (hh.RASH(rings=5), 1),
        (hh.BlockMean(method=BlockMethod.OVERLAP), 121), (hh.BlockMean(method=BlockMethod.ROTATION), 768), (hh.BlockMean(method=BlockMethod.ROTATION_OVERLAP), 2883),
        (hh.LBP(grid_x=2, grid_y=2), 1024), (hh.GIST(grid_x=2, grid_y=2), 80), (hh.Zernike(degree=4), 8), (hh.HOG(width=32, height=32), 144),
        (hh.BoVW(storage=Storage.MINHASH), 64), (hh.BoVW(storage=Storage.SIMHASH, feature=Feature.AKAZE), 16),
    ],
)
def test_lengths(spark, hasher, n):
    assert len(rasters(spark, GRAY).select(hasher.hash("raster").alias("h")).first()["h"]) == n


@pytest.mark.parametrize(
    "make,error",
    [
        (lambda: hh.Average(width=0), err.InvalidSize), (lambda: hh.Average(interpolation=99), err.InvalidInterpolation), (lambda: hh.Median(width=2, height=1), err.InvalidSize),
        (lambda: hh.PHash(width=16, height=32), err.InvalidSize), (lambda: hh.WHash(level=0), err.InvalidLevel), (lambda: hh.BlockMean(block_width=0), err.InvalidBlockSize),
        (lambda: hh.BlockMean(block_width=300), err.InvalidBlockSize), (lambda: hh.MarrHildreth(scale=0), err.InvalidScale), (lambda: hh.MarrHildreth(alpha=-1), err.InvalidAlpha),
        (lambda: hh.MarrHildreth(kernel=4), err.InvalidKernelSize), (lambda: hh.MarrHildreth(sigma=-1), err.InvalidSigma), (lambda: hh.MarrHildreth(width=100), err.InvalidSize),
        (lambda: hh.RASH(rings=0), err.InvalidRings), (lambda: hh.RASH(sigma=0), err.InvalidSigma), (lambda: hh.RadialVariance(angles=0), err.InvalidAngles), (lambda: hh.RadialVariance(sigma=-1), err.InvalidSigma),
        (lambda: hh.ColorMoment(kernel=0), err.InvalidKernelSize), (lambda: hh.LBP(grid_x=0), err.InvalidGridSize), (lambda: hh.GIST(grid_y=0), err.InvalidGridSize), (lambda: hh.HOG(cell=0), err.InvalidCellSize),
        (lambda: hh.HOG(bins=0), err.InvalidBinCount), (lambda: hh.Zernike(degree=0), err.InvalidDegree), (lambda: hh.BoVW(feature=0), err.InvalidFeature), (lambda: hh.BoVW(storage=9), err.InvalidStorage),
        (lambda: hh.BoVW(vocabulary=0), err.InvalidVocabularySize), (lambda: hh.BoVW(max_keypoints=0), err.InvalidMaxKeypoints), (lambda: hh.BoVW(minhash_size=0), err.InvalidMinHashSize), (lambda: hh.BoVW(simhash_bits=0), err.InvalidSimHashBits),
        (lambda: hh.BoVW(interpolation=-1), err.InvalidInterpolation), (lambda: hh.PDQ(width=3), TypeError), (lambda: hh.Average(level=2), TypeError),
    ],
)
def test_options(make, error):
    with pytest.raises(error):
        make()


def test_native_and_kernel_agree(spark):
    small = [RNG.integers(0, 256, (8, 8)) for _ in range(20)]
    df = rasters(spark, *small).select("raster", F.col("raster.pixels").alias("p"))
    both = [
        (hh.Average(), rs.average_hash(F.col("p"))), (hh.Median(), rs.median_hash(F.col("p"))), (hh.Difference(width=7), rs.difference_hash(F.col("p"), 8, 8)),
        (hh.BlockMean(width=8, height=8, block_width=2, block_height=4), rs.block_mean_hash(F.col("p"), 8, 8, 2, 4)),
        (hh.BlockMean(width=8, height=8, block_width=4, block_height=2, method=BlockMethod.OVERLAP), rs.block_mean_hash(F.col("p"), 8, 8, 4, 2, True)),
        (hh.WHash(width=4, height=4, level=1), rs.wavelet_hash(F.col("p"), 8, 8, 1)),
    ]
    for hasher, native in both:
        for r in df.select(hasher.hash("raster").alias("a"), native.alias("b")).collect():
            assert r["a"] == r["b"], hasher


def test_resample_agrees(spark):
    df = rasters(spark, RNG.integers(0, 256, (9, 6)))
    for i in Interpolation:
        got = df.select(rs.resample(F.col("raster.pixels"), 6, 9, 4, 13, i).alias("x")).first()["x"]
        from pixelsieve.kernels import imaging as im

        x = np.array(df.first()["raster"]["pixels"], np.uint8).reshape(1, 9, 6)
        assert np.array_equal(got, im.resize(x, 4, 13, i).ravel())


def png(x, filter_=0):
    h, w = x.shape[:2]
    c = 1 if x.ndim == 2 else x.shape[2]
    lines, above = [], np.zeros((w, c), int)
    for y in range(h):
        row = x[y].reshape(w, c).astype(int)
        left = np.vstack((np.zeros((1, c), int), row[:-1]))
        corner = np.vstack((np.zeros((1, c), int), above[:-1]))
        if filter_ == 4:
            p = left + above - corner
            a, b, d = abs(p - left), abs(p - above), abs(p - corner)
            guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, above, corner))
        else:
            guess = [0, left, above, (left + above) // 2][filter_]
        lines.append(bytes([filter_]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png(spark):
    for filter_ in range(5):
        for x in (RNG.integers(0, 256, (7, 9)), RNG.integers(0, 256, (7, 9, 3)), RNG.integers(0, 256, (5, 4, 4))):
            want = x[..., :3] if x.ndim == 3 else x
            assert np.array_equal(src.decode_png(png(x, filter_)), want)
    rows = spark.createDataFrame([(png(GRAY),), (b"junk",), (None,), (png(COLOUR),)], "content binary").select(src.decode("content").alias("r")).collect()
    contents = spark.createDataFrame([(1, png(GRAY)), (2, b"junk")], "id long, content binary")
    hashed = {r["id"]: r["hash"] for r in src.hash_contents(contents, hh.Average()).collect()}
    assert hashed[2] is None and hashed[1] == rasters(spark, GRAY).select(hh.Average().hash("raster").alias("h")).first()["h"]
    assert [r["r"]["width"] for r in rows] == [61, None, None, 40] and rows[3]["r"]["pixels"] == COLOUR.ravel().tolist()


def test_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(GRAY))
    (tmp_path / "b.png").write_bytes(png(COLOUR))
    (tmp_path / "c.png").write_bytes(b"no image")
    (tmp_path / "d.txt").write_bytes(b"text")
    for hasher in (hh.Average(), hh.CLD(), hh.ColorMoment(width=16, height=16)):
        got = {r["origin"][-5:]: r["hash"] for r in src.hash_files(spark, str(tmp_path), hasher).collect()}
        want = [r["h"] for r in rasters(spark, GRAY, COLOUR).select(hasher.hash("raster").alias("h")).collect()]
        assert (got["a.png"], got["b.png"]) == tuple(want) and got.get("c.png") is None and "d.txt" not in got
    assert src.hash_files(spark, str(tmp_path), hh.Average(), drop_invalid=True).count() == 2
    with pytest.raises(Exception):
        src.read_images(spark, str(tmp_path / "nowhere")).count()
    src.write_hashes(src.hash_files(spark, str(tmp_path), hh.Average(), True), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.png").write_bytes(png(GRAY if k < 2 else COLOUR))
    hashed = hashing.hash_stream(hashing.read_image_stream(spark, str(folder)), hh.Average())
    known = rasters(spark, GRAY).select("id", hh.Average().hash("raster").alias("hash"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(hashed.select("path", "hash"), "hashes")) == 3
    assert len(run(hashing.first_seen(hashed).select("path"), "firsts")) == 2
    near = run(hashing.alerts(hashed, known, "id", 8, 3).select("path", "known_id", "distance"), "alerts")
    assert len(near) == 2 and all(r["distance"] == 0 and r["known_id"] == 0 for r in near)


def test_sql_function(spark):
    hh.register(spark, "average_hash", hh.Average())
    rasters(spark, GRAY).createOrReplaceTempView("some_images")
    assert len(spark.sql("select average_hash(raster) h from some_images").first()["h"]) == 8


def test_own_metric_and_kernel(spark):
    hasher = hh.CLD(metric=lambda a, b: F.abs(F.element_at(a, 1) - F.element_at(b, 1)).cast("double"))
    df = spark.createDataFrame([([5, 1], [9, 9])], "a array<int>, b array<int>")
    assert df.select(hasher.distance("a", "b").alias("d")).first()["d"] == 4
    out = rasters(spark, GRAY, None).select(kc.vector_column("raster", lambda x: x.reshape(len(x), -1)[:, :2]).alias("v")).collect()
    assert out[0]["v"] == GRAY.ravel()[:2].tolist() and out[1]["v"] is None


def test_stream_of_all_formats(spark, tmp_path):
    """JPEG, GIF and PNG files of one picture get one hash; a file that is no image gets none."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(16, 16, 1)
    for y in range(16):
        for x in range(16):
            image.setRGB(x, y, 0xFFFFFF if (x < 8) == (y < 8) else 0)
    for kind in ("jpg", "gif", "png"):
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(folder / f"a.{kind}")))
    (folder / "b.jpg").write_bytes(b"no image")
    query = hashing.hash_stream(hashing.read_image_stream(spark, str(folder)), hh.Average()).select("path", "modificationTime", "hash").writeStream.format("memory").queryName("mixed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in spark.table("mixed").collect()}
    assert len(rows) == 4 and all(r["modificationTime"] is not None for r in rows.values())
    assert rows["a.jpg"]["hash"] == rows["a.gif"]["hash"] == rows["a.png"]["hash"] != None and rows["b.jpg"]["hash"] is None  # noqa: E711


@pytest.mark.parametrize("side", [256, 512])
def test_enlarged_images_come_a_few_at_a_time(spark, side):
    """Small images that a hasher enlarges: a batch is bounded by what is made of them, not by their own size."""

    class Batch(hh.BlockMean):
        def compute(self, images):
            return np.full((len(images), 1), len(images))

    hasher = Batch(width=side, height=side)
    df = spark.range(300).select(src.gray_raster(F.array_repeat(F.lit(7), 64), 8, 8).alias("raster")).coalesce(1)
    most = max(r["h"][0] for r in df.select(hasher.hash("raster").alias("h")).collect())
    assert 1 < most * side * side <= hh.VALUES


def test_long_hashes_are_handed_on_a_few_at_a_time():
    rows = pd.DataFrame({"height": 8, "width": 8, "channels": 1, "pixels": [np.full(64, k % 256, np.int32) for k in range(700)]})
    rows.loc[[3, 699], "pixels"] = None
    parts = list(hh.results_of(rows, lambda x: x[:, 0, :1]))
    assert max(map(len, parts)) <= hh.ROWS
    assert [None if v is None else v[0] for v in pd.concat(parts)] == [None if k in (3, 699) else k % 256 for k in range(700)]

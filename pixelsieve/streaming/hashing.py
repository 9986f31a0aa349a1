"""Hashes of image streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.functions import metrics
from pixelsieve.operators.similarity import EXPECTED, lay_out
from pixelsieve.sources.images import PATTERN

_IMAGES = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def read_image_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, modificationTime and raster of the image files (JPEG, PNG, GIF) that appear below a path, decoded by
    Spark's own source; files that are no image have a width of -1 and give null hashes."""
    reader = spark.readStream.format("image").schema(_IMAGES).option("pathGlobFilter", PATTERN).option("recursiveFileLookup", True)
    rows = reader.option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime"), F.col("image").alias("raster"))


def hash_stream(stream: DataFrame, hasher, raster: str = "raster") -> DataFrame:
    """The stream with a hash column. Hashing keeps no state."""
    return stream.withColumn("hash", hasher.hash(F.col(raster)))


def first_seen(stream: DataFrame, hash_col: str = "hash", time_col: str = "modificationTime", within: str = "1 hour") -> DataFrame:
    """Of rows with one hash that come within a time of each other the first; the state is bounded by the watermark."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([hash_col])


def alerts(stream: DataFrame, known: DataFrame, id_col: str, length: int, threshold: int, hash_col: str = "hash", expected: int = EXPECTED) -> DataFrame:
    """Rows of the stream that are within `threshold` bits of a known hash: a join with the static side on bands, whose
    keys a few flipped bits of a known hash's bands give (as in hamming_join())."""
    bands = lay_out(length, threshold, expected)
    left = stream.withColumn("__bands", bands.values(F.col(hash_col))).select("*", F.posexplode("__bands").alias("__at", "__value"))
    right = known.select(F.col(id_col).alias("known_id"), F.col(hash_col).alias("known_hash"), bands.values(F.col(hash_col)).alias("__known"))
    right = right.select("*", F.explode(bands.reached("__known")).alias("__x")).select("known_id", "known_hash", "__known", F.col("__x.at").alias("__at"), F.col("__x.value").alias("__value"))
    near = left.join(right, ["__at", "__value"]).withColumn("distance", metrics.hamming(F.col(hash_col), F.col("known_hash")))
    near = near.where((F.col("distance") <= threshold) & (bands.first("__bands", "__known") == F.col("__at")))
    return near.drop("__bands", "__known", "__at", "__value")

"""Images in, hashes out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the decoders read.
PATTERN = "*.{jpg,jpeg,png,gif,JPG,JPEG,PNG,GIF}"
RASTER = "struct<height:int,width:int,channels:int,pixels:array<int>>"


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False, recursive: bool = True) -> DataFrame:
    """origin and image, one row a file, decoded by Spark's own source. Files that are no image have a width of
    -1 and give null hashes, or are dropped. A path that isn't there is an error."""
    reader = spark.read.format("image").option("dropInvalid", drop_invalid).option("pathGlobFilter", PATTERN)
    rows = reader.option("recursiveFileLookup", recursive).load(path)
    return rows.select(F.col("image.origin").alias("origin"), F.col("image"))


def hash_files(spark: SparkSession, path: str, hasher, drop_invalid: bool = False) -> DataFrame:
    """origin and hash of every image below a path."""
    return read_images(spark, path, drop_invalid).select("origin", hasher.hash(F.col("image")).alias("hash"))


def hash_contents(df: DataFrame, hasher, content: str = "content", out: str = "hash") -> DataFrame:
    """df with the hashes of a column of PNG bytes; null where they can't be decoded."""
    return df.withColumn(out, hasher.hash(decode(content)))


def write_hashes(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Hashes as Parquet."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def decode_png(data: bytes) -> np.ndarray:
    """8-bit gray or RGB pixels of a PNG without interlacing; alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, palette = 8, [], None
    width = height = depth = colour = interlace = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or interlace or not channels or not width or not height:
        raise ValueError("a PNG of an unsupported kind")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.int64)
    for y in range(height):
        line, filter_ = raw[y, 1:].reshape(width, channels).astype(np.int64), raw[y, 0]
        if filter_ == 1:
            line = np.cumsum(line, axis=0) & 255
        elif filter_ == 2:
            line = (line + above) & 255
        elif filter_ in (3, 4):
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = above[x]
                if filter_ == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        out[y] = line
        above = line
    if colour == 3:
        return palette[out[..., 0]]
    return out[..., 0] if colour in (0, 4) else out[..., :3]


def decode(content: Column | str) -> Column:
    """A raster of a column of PNG bytes; null where they can't be decoded. Other formats go by read_images()."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            rows = []
            for data in contents:
                try:
                    x = decode_png(bytes(data))
                    rows.append((x.shape[0], x.shape[1], 1 if x.ndim == 2 else 3, x.astype(np.int32).ravel()))
                except (TypeError, ValueError, zlib.error, struct.error):
                    rows.append((None, None, None, None))
            yield pd.DataFrame(rows, columns=["height", "width", "channels", "pixels"]).astype({c: "Int32" for c in ("height", "width", "channels")})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RASTER)(content)


def gray_raster(pixels: Column, width: int, height: int) -> Column:
    """A raster struct of an array of gray pixels."""
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"), pixels.alias("pixels"))


def colour_raster(r: Column, g: Column, b: Column, width: int, height: int) -> Column:
    """A raster struct of three arrays of equal length."""
    pixels = F.flatten(F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: F.array(p["r"], p["g"], p["b"])))
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(3).alias("channels"), pixels.alias("pixels"))

"""Between pixel tables (id, y, x, value) and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.sources.images import gray_raster


def rasterize(df: DataFrame, key: str, y: str, x: str, value: str, width: int, height: int) -> DataFrame:
    """key and raster: a gray raster for each key; pixels without a row are 0, values are cut to 0..255, and of
    several rows for a pixel the sum counts. Pixels are summed up before the shuffle by key."""
    place = (F.col(y) * width + F.col(x)).cast("int")
    inside = F.col(y).between(0, height - 1) & F.col(x).between(0, width - 1)
    cells = df.where(inside).groupBy(key, place.alias("__at")).agg(F.sum(value).alias("__v"))
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__at", "__v"))).alias("__m"))
    pixel = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(F.try_element_at("__m", k), F.lit(0)))).cast("int")
    return maps.select(key, gray_raster(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel), width, height).alias("raster"))


def pixels(df: DataFrame, key: str, raster: Column | str) -> DataFrame:
    """key, y, x, v: a row for each pixel of gray rasters."""
    r = F.col(raster) if isinstance(raster, str) else raster
    rows = df.select(key, r["width"].alias("__w"), F.posexplode(r["pixels"]).alias("__k", "v"))
    return rows.select(key, F.floor(F.col("__k") / F.col("__w")).cast("int").alias("y"), (F.col("__k") % F.col("__w")).alias("x"), "v")

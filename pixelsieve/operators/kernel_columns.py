"""Columns of intermediate results: any batch kernel over a raster column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.kernels import descriptors as ds
from pixelsieve.kernels import imaging as im
from pixelsieve.operators.hashers import images_of, results_of
from pixelsieve.types import Feature, Interpolation


def vector_column(raster: Column | str, kernel: Callable[[np.ndarray], np.ndarray], kind: str = "array<double>") -> Column:
    """A column of kernel's rows: it gets batches of equal-sized images, and returns one row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rasters in batches:
            yield from results_of(rasters, kernel)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)(raster)


def side_by_side(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate([p.reshape(len(p), -1) for p in parts], axis=1)


def keypoints(df: DataFrame, id_col: str, raster_col: str, feature: Feature, side: int, most: int) -> DataFrame:
    """A row for each keypoint of images resized to side x side: id, rank, x, y, response, angle."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, rank int, x int, y int, response double, angle double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rasters = pd.DataFrame(list(rows["raster"]))
            parts = []
            for at, images in images_of(rasters, lambda h, w: side * side):
                for k, image in zip(at.tolist(), im.to_gray(im.resize(images, side, side, Interpolation.BILINEAR)), strict=True):
                    x, y, r, a = ds.keypoints(image, feature, most)
                    parts.append(pd.DataFrame({"id": rows["id"].iloc[k], "rank": np.arange(1, len(x) + 1), "x": x, "y": y, "response": r, "angle": np.round(a, 6)}))
            if parts:
                yield pd.concat(parts)

    return df.select(F.col(id_col).alias("id"), F.col(raster_col).alias("raster")).mapInPandas(run, schema)

"""The eighteen hashers.

A hasher is an immutable configuration, checked when it is built. `hash(column)` gives a column of hashes for a
column of rasters: one Arrow-batched function for all of the hasher's steps, over equal-sized images at a time.
`distance(a, b)` compares two hash columns with JVM expressions, after checks of kind and length; `metric=` puts
another metric in place of the default one.

A raster is a struct of height, width, channels (1 or 3) and pixels (array of 0 to 255, row-major, RGB), or a
row of Spark's image source (height, width, nChannels, mode, data: BGR bytes). A null raster gives a null hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve import errors as err
from pixelsieve.functions import metrics
from pixelsieve.kernels import descriptors as ds
from pixelsieve.kernels import imaging as im
from pixelsieve.types import BlockMethod, Feature, Interpolation, Kind, Storage

Metric = Callable[[Column, Column], Column]

#: Values that a kernel works on at a time, and rows whose results are handed on together: both bound what a worker
#: holds, however many rows Arrow brings, however far images are enlarged and however long their hashes are.
VALUES, ROWS = 1 << 20, 256


def images_of(rasters: pd.DataFrame, work: Callable[[int, int], int] = lambda h, w: h * w) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of equal-sized images of a raster column, each with their positions in it. work: the values that a
    kernel makes of an image of that height and width, by channel."""
    source = "data" if "data" in rasters.columns else "pixels"
    channels = rasters["nChannels" if source == "data" else "channels"]
    shapes: dict[tuple[int, int, int], list[int]] = {}
    for k, (h, w, c, p) in enumerate(zip(rasters["height"], rasters["width"], channels, rasters[source], strict=True)):
        if p is not None and h is not None and h == h and h > 0:
            shapes.setdefault((int(h), int(w), int(c)), []).append(k)
    for (h, w, c), at in shapes.items():
        step = max(1, VALUES // (max(h * w, work(h, w)) * c))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            if source == "data":
                x = np.stack([np.frombuffer(rasters[source][k], np.uint8) for k in some]).reshape(-1, h, w, c)
                x = x[..., 0] if c == 1 else x[..., 2::-1]
            else:
                x = np.stack([np.asarray(rasters[source][k]) for k in some]).astype(np.uint8).reshape((-1, h, w) if c == 1 else (-1, h, w, c))
            yield np.array(some), np.ascontiguousarray(x)


def results_of(rasters: pd.DataFrame, kernel: Callable[[np.ndarray], np.ndarray], work: Callable[[int, int], int] = lambda h, w: h * w) -> Iterator[pd.Series]:
    """The kernel's row for each raster, a few rows at a time; null for a raster without an image."""
    for lo in range(0, len(rasters), ROWS):
        part = rasters.iloc[lo : lo + ROWS].reset_index(drop=True)
        out: list = [None] * len(part)
        for at, images in images_of(part, work):
            for k, row in zip(at.tolist(), kernel(images), strict=True):
                out[k] = row.tolist()
        yield pd.Series(out, dtype=object)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make fewer tasks than there are cores; hashing takes far longer than
    moving a few small rasters. Larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@dataclass(frozen=True, kw_only=True)
class Hasher:
    """What all hashers share."""

    metric: Metric | None = field(default=None, compare=False)

    kind = Kind.BINARY

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        for f in fields(self):
            if f.name in ("width", "height") and not getattr(self, f.name) > 0:
                raise err.InvalidSize(f"{f.name} must be positive")
            if f.name == "interpolation":
                if getattr(self, f.name) not in list(Interpolation):
                    raise err.InvalidInterpolation(f"unknown interpolation {getattr(self, f.name)}")
                object.__setattr__(self, "interpolation", Interpolation(self.interpolation))

    def _need(self, ok: bool, error: type[Exception], message: str) -> None:
        if not ok:
            raise error(message)

    def compute(self, images: np.ndarray) -> np.ndarray:
        """A row for each image of a batch (n, h, w) or (n, h, w, 3)."""
        raise NotImplementedError

    def work(self, height: int, width: int) -> int:
        """The values that compute() makes of an image of this size, by channel."""
        return max(height * width, getattr(self, "height", 0) * getattr(self, "width", 0))

    def sized_gray(self, images: np.ndarray) -> np.ndarray:
        return im.to_gray(im.resize(images, self.width, self.height, self.interpolation))

    def hash(self, raster: Column | str) -> Column:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for rasters in batches:
                yield from results_of(rasters, self.compute, self.work)

        run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, self.kind.spark_type)(raster)

    def default_metric(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def distance(self, a: Column | str, b: Column | str) -> Column:
        """Compares two columns of this hasher's hashes; other lengths raise, whatever the metric."""
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        return metrics.same_length(a, b, (self.metric or self.default_metric)(a, b))

    def hash_files(self, df: DataFrame, image: str = "image", out: str = "hash") -> DataFrame:
        return df.withColumn(out, self.hash(image))


def _hamming(self, a: Column, b: Column) -> Column:
    return metrics.hamming(a, b)


@dataclass(frozen=True, kw_only=True)
class _Sized(Hasher):
    width: int = 8
    height: int = 8
    interpolation: Interpolation = Interpolation.BILINEAR


@dataclass(frozen=True, kw_only=True)
class Average(_Sized):
    default_metric = _hamming

    def compute(self, images):
        return ds.mean_bits(self.sized_gray(images))


@dataclass(frozen=True, kw_only=True)
class Median(_Sized):
    default_metric = _hamming

    def validate(self):
        super().validate()
        self._need(self.width * self.height != 2, err.InvalidSize, "two pixels have no such median")

    def compute(self, images):
        return ds.median_bits(self.sized_gray(images))


@dataclass(frozen=True, kw_only=True)
class Difference(_Sized):
    default_metric = _hamming

    def compute(self, images):
        return ds.rising_bits(im.to_gray(im.resize(images, self.width + 1, self.height, self.interpolation)))


@dataclass(frozen=True, kw_only=True)
class PHash(_Sized):
    width: int = 32
    height: int = 32
    interpolation: Interpolation = Interpolation.BILINEAR_EXACT
    weights: tuple[float, ...] = ()

    def validate(self):
        super().validate()
        object.__setattr__(self, "weights", tuple(self.weights) or (1.0,) * 8)
        self._need(self.width == self.height >= 8, err.InvalidSize, "width and height must be equal, 8 at least")

    def default_metric(self, a, b):
        return metrics.weighted_hamming(a, b, self.weights)

    def compute(self, images):
        return ds.dct_bits(self.sized_gray(images))


@dataclass(frozen=True, kw_only=True)
class WHash(_Sized):
    default_metric = _hamming
    level: int = 3

    def validate(self):
        super().validate()
        self._need(self.level > 0, err.InvalidLevel, "level must be positive")

    def work(self, height, width):
        return max(height * width, (self.width << self.level) * (self.height << self.level))

    def compute(self, images):
        wide = im.resize(images, self.width << self.level, self.height << self.level, self.interpolation)
        return ds.haar_bits(im.to_gray(wide), self.level)


@dataclass(frozen=True, kw_only=True)
class BlockMean(_Sized):
    default_metric = _hamming
    width: int = 256
    height: int = 256
    interpolation: Interpolation = Interpolation.BILINEAR_EXACT
    block_width: int = 16
    block_height: int = 16
    method: BlockMethod = BlockMethod.DIRECT

    def validate(self):
        super().validate()
        self._need(0 < self.block_width <= self.width and 0 < self.block_height <= self.height, err.InvalidBlockSize, "a block must be positive and fit into the image")

    def compute(self, images):
        overlap = self.method in (BlockMethod.OVERLAP, BlockMethod.ROTATION_OVERLAP)
        turns = 24 if self.method in (BlockMethod.ROTATION, BlockMethod.ROTATION_OVERLAP) else 1
        return ds.block_bits(self.sized_gray(images), self.block_width, self.block_height, overlap, turns)


@dataclass(frozen=True, kw_only=True)
class MarrHildreth(_Sized):
    default_metric = _hamming
    width: int = 512
    height: int = 512
    interpolation: Interpolation = Interpolation.BICUBIC
    scale: float = 1.0
    alpha: float = 2.0
    kernel: int = 7
    sigma: float = 0.0

    def validate(self):
        super().validate()
        self._need(min(self.width, self.height) >= ds.MH_BLOCKS * ds.MH_SIDE, err.InvalidSize, "width and height must be 496 at least")
        self._need(self.scale > 0, err.InvalidScale, "scale must be positive")
        self._need(self.alpha > 0, err.InvalidAlpha, "alpha must be positive")
        self._need(self.kernel > 0 and self.kernel % 2 == 1, err.InvalidKernelSize, "the kernel size must be positive and odd")
        self._need(self.sigma >= 0, err.InvalidSigma, "sigma must not be negative")

    def compute(self, images):
        blurred = im.gaussian_blur(im.to_gray(images), self.kernel, self.sigma)
        sized = im.equalize(im.resize(blurred, self.width, self.height, self.interpolation))
        return ds.marr_hildreth_bits(sized, self.scale, self.alpha)


@dataclass(frozen=True, kw_only=True)
class PDQ(Hasher):
    default_metric = _hamming
    interpolation: Interpolation = Interpolation.BILINEAR
    width = height = 64

    def compute(self, images):
        return ds.pdq_bits(self.sized_gray(images))


def _need_sigma(self) -> None:
    self._need(self.sigma > 0, err.InvalidSigma, "sigma must be positive")


@dataclass(frozen=True, kw_only=True)
class RASH(_Sized):
    default_metric = _hamming
    width: int = 256
    height: int = 256
    sigma: float = 1.0
    rings: int = 180

    def validate(self):
        super().validate()
        _need_sigma(self)
        self._need(self.rings > 0, err.InvalidRings, "rings must be positive")

    def compute(self, images):
        return ds.ring_bits(im.gaussian_blur(self.sized_gray(images), 0, self.sigma), self.rings)


@dataclass(frozen=True, kw_only=True)
class RadialVariance(Hasher):
    kind = Kind.UINT8
    sigma: float = 1.0
    angles: int = 180

    def validate(self):
        super().validate()
        self._need(self.angles > 0, err.InvalidAngles, "angles must be positive")
        _need_sigma(self)

    def default_metric(self, a, b):
        return metrics.l1(a, b)

    def work(self, height, width):
        return max(height * width, self.angles * max(height, width))

    def compute(self, images):
        return ds.radial_bytes(im.gaussian_blur(im.to_gray(images), 0, self.sigma), self.angles)


@dataclass(frozen=True, kw_only=True)
class ColorMoment(_Sized):
    kind = Kind.FLOAT64
    width: int = 512
    height: int = 512
    interpolation: Interpolation = Interpolation.BICUBIC
    kernel: int = 3
    sigma: float = 0.0

    def validate(self):
        super().validate()
        self._need(self.kernel > 0 and self.kernel % 2 == 1, err.InvalidKernelSize, "the kernel size must be positive and odd")
        self._need(self.sigma >= 0, err.InvalidSigma, "sigma must not be negative")

    def default_metric(self, a, b):
        return metrics.l2(a, b)

    def compute(self, images):
        sized = im.resize(images, self.width, self.height, self.interpolation)
        return ds.colour_moments(im.gaussian_blur(im.in_colour(sized), self.kernel, self.sigma))


@dataclass(frozen=True, kw_only=True)
class CLD(_Sized):
    kind = Kind.UINT8
    width: int = 64
    height: int = 64

    def default_metric(self, a, b):
        return metrics.l2(a, b)

    def compute(self, images):
        return ds.layout_bytes(im.resize(images, self.width, self.height, self.interpolation))


@dataclass(frozen=True, kw_only=True)
class EHD(_Sized):
    kind = Kind.UINT8
    width: int = 256
    height: int = 256

    def default_metric(self, a, b):
        return metrics.l1(a, b)

    def compute(self, images):
        return ds.edge_bytes(self.sized_gray(images))


@dataclass(frozen=True, kw_only=True)
class LBP(_Sized):
    kind = Kind.UINT8
    width: int = 256
    height: int = 256
    grid_x: int = 1
    grid_y: int = 1

    def validate(self):
        super().validate()
        self._need(0 < self.grid_x <= self.width and 0 < self.grid_y <= self.height, err.InvalidGridSize, "the grid must be positive and fit into the image")

    def default_metric(self, a, b):
        return metrics.chi_square(a, b)

    def compute(self, images):
        return ds.lbp_bytes(self.sized_gray(images), self.grid_x, self.grid_y)


@dataclass(frozen=True, kw_only=True)
class HOG(_Sized):
    kind = Kind.UINT8
    width: int = 256
    height: int = 256
    cell: int = 8
    bins: int = 9

    def validate(self):
        super().validate()
        self._need(self.cell > 0, err.InvalidCellSize, "the cell size must be positive")
        self._need(self.bins > 0, err.InvalidBinCount, "the number of bins must be positive")

    def default_metric(self, a, b):
        return metrics.cosine(a, b)

    def compute(self, images):
        return ds.gradient_bytes(self.sized_gray(images), self.cell, self.bins)


@dataclass(frozen=True, kw_only=True)
class GIST(_Sized):
    kind = Kind.FLOAT64
    width: int = 64
    height: int = 64
    grid_x: int = 4
    grid_y: int = 4

    def validate(self):
        super().validate()
        self._need(0 < self.grid_x <= self.width and 0 < self.grid_y <= self.height, err.InvalidGridSize, "the grid must be positive and fit into the image")

    def default_metric(self, a, b):
        return metrics.cosine(a, b)

    def compute(self, images):
        return ds.gist(self.sized_gray(images), self.grid_x, self.grid_y)


@dataclass(frozen=True, kw_only=True)
class Zernike(_Sized):
    kind = Kind.FLOAT64
    width: int = 64
    height: int = 64
    degree: int = 8

    def validate(self):
        super().validate()
        self._need(self.degree > 0, err.InvalidDegree, "the degree must be positive")

    def default_metric(self, a, b):
        return metrics.l2(a, b)

    def compute(self, images):
        return ds.zernike_magnitudes(self.sized_gray(images), self.degree)


@dataclass(frozen=True, kw_only=True)
class BoVW(_Sized):
    width: int = 256
    height: int = 256
    feature: Feature = Feature.ORB
    storage: Storage = Storage.HISTOGRAM
    vocabulary: int = 256
    max_keypoints: int = 500
    minhash_size: int = 64
    simhash_bits: int = 128

    def validate(self):
        super().validate()
        self._need(self.feature in list(Feature), err.InvalidFeature, "unknown feature")
        self._need(self.storage in list(Storage), err.InvalidStorage, "unknown storage")
        self._need(self.vocabulary > 0, err.InvalidVocabularySize, "the vocabulary must be positive")
        self._need(self.max_keypoints > 0, err.InvalidMaxKeypoints, "the number of keypoints must be positive")
        self._need(self.minhash_size > 0, err.InvalidMinHashSize, "the MinHash size must be positive")
        self._need(self.simhash_bits > 0, err.InvalidSimHashBits, "the number of SimHash bits must be positive")

    @property
    def kind(self):
        return Kind.BINARY if self.storage == Storage.SIMHASH else Kind.FLOAT64

    def default_metric(self, a, b):
        return metrics.cosine(a, b) if self.storage == Storage.HISTOGRAM else metrics.jaccard(a, b, self.kind)

    def compute(self, images):
        gray = self.sized_gray(images)
        return ds.visual_words(gray, Feature(self.feature), Storage(self.storage), self.vocabulary, self.max_keypoints, self.minhash_size, self.simhash_bits)


HASHERS = {c.__name__: c for c in (Average, Median, Difference, PHash, WHash, BlockMean, MarrHildreth, PDQ, RASH, RadialVariance, ColorMoment, CLD, EHD, LBP, HOG, GIST, Zernike, BoVW)}


def register(spark, name: str, hasher: Hasher) -> None:
    """Makes a hasher's `hash` a SQL function of a raster struct."""

    def run(rasters: pd.DataFrame) -> pd.Series:
        parts = list(results_of(rasters, hasher.compute, hasher.work))
        return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=object)

    run.__annotations__ = {"rasters": pd.DataFrame, "return": pd.Series}
    spark.udf.register(name, F.pandas_udf(run, hasher.kind.spark_type))

"""Native raster expressions: arrays of pixels (row-major) whose size is known when the plan is built.

Everything here stays in the JVM. A value that many lambdas need, like an image's mean, is put beside the pixels
in a one-element array first; inlined into the lambdas it would be computed again for every pixel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelsieve.functions.hashes import pack
from pixelsieve.kernels import imaging as im
from pixelsieve.types import Interpolation


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def round_half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5)).cast("double")


# Colour, of three whole-number columns


def gray_luma(r: Column, g: Column, b: Column) -> Column:
    wide = [c.cast("long") * 257 for c in (r, g, b)]
    return F.shiftright(19595 * wide[0] + 38470 * wide[1] + 7471 * wide[2] + 32768, 24).cast("int")


def _byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int")


def ycrcb(r: Column, g: Column, b: Column) -> Column:
    """A struct of y, cr and cb."""
    r, g, b = (c.cast("int") for c in (r, g, b))
    y = F.shiftright(4899 * r + 9617 * g + 1868 * b + 8192, 14)
    cr = F.shiftright((r - y) * 11682 + (128 << 14) + 8192, 14)
    cb = F.shiftright((b - y) * 9241 + (128 << 14) + 8192, 14)
    return F.struct(_byte(y).alias("y"), _byte(cr).alias("cr"), _byte(cb).alias("cb"))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """A struct of h (0 to 179), s and v."""
    r, g, b = (c.cast("int") for c in (r, g, b))
    v = F.greatest(r, g, b)
    spread = v - F.least(r, g, b)

    def share(top: int, by: Column) -> Column:
        return F.when(by == 0, F.lit(0)).otherwise(F.floor(F.lit(float(top << 12)) / by + 0.5).cast("int"))

    s = F.shiftright(spread * share(255, v) + 2048, 12)
    raw = F.when(v == r, g - b).when(v == g, b - r + 2 * spread).otherwise(r - g + 4 * spread)
    h = F.shiftright(raw * share(30, spread) + 2048, 12)
    return F.struct(_byte(F.when(h < 0, h + 180).otherwise(h)).alias("h"), s.alias("s"), v.alias("v"))


# Statistics


def gray_mean(p: Column) -> Column:
    return F.when(F.size(p) == 0, F.lit(0.0)).otherwise(_sum(p) / F.size(p))


def gray_median(p: Column) -> Column:
    """For an even count the mean of the values before and after the upper middle, 0 for no pixel."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        at = F.floor(n / 2).cast("int")
        even = (F.try_element_at(s, at) + F.try_element_at(s, at + 2)) / 2
        return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.try_element_at(s, at + 1).cast("double")).otherwise(even)

    return let(F.array_sort(p), middle)


def _above(p: Column, threshold: Column) -> Column:
    return let(F.struct(p.alias("p"), threshold.alias("t")), lambda s: pack(F.transform(s["p"], lambda v: v > s["t"])))


def average_hash(p: Column) -> Column:
    return _above(p, round_half_away(gray_mean(p)))


def median_hash(p: Column) -> Column:
    return _above(p, round_half_away(gray_median(p)))


def difference_hash(p: Column, width: int, height: int) -> Column:
    """Of a raster one pixel wider than the hash."""
    places = F.array(*[F.lit(y * width + x) for y in range(height) for x in range(1, width)])
    return pack(F.transform(places, lambda i: F.element_at(p, i + 1) > F.element_at(p, i)))


# Blocks


def block_means(p: Column, width: int, height: int, bw: int, bh: int, overlap: bool = False) -> Column:
    columns, rows, dx, dy = width // bw, height // bh, bw, bh
    if overlap:
        columns, rows, dx, dy = 2 * columns - 1, 2 * rows - 1, bw // 2, bh // 2
    starts = F.array(*[F.lit(y * dy * width + x * dx) for y in range(rows) for x in range(columns)])
    inner = F.array(*[F.lit(y * width + x) for y in range(bh) for x in range(bw)])
    return F.transform(starts, lambda s: _sum(F.transform(inner, lambda o: F.element_at(p, s + o + 1))) / (bw * bh))


def block_mean_hash(p: Column, width: int, height: int, bw: int, bh: int, overlap: bool = False) -> Column:
    both = F.struct(block_means(p, width, height, bw, bh, overlap).alias("b"), gray_mean(p).alias("m"))
    return let(both, lambda s: pack(F.transform(s["b"], lambda v: v >= s["m"])))


def haar_low(p: Column, width: int, height: int, levels: int) -> Column:
    """The low-frequency part; of bytes its values are exact."""
    side = 1 << levels
    return block_means(p, width, height, side, side)


def wavelet_hash(p: Column, width: int, height: int, levels: int) -> Column:
    """Against the usual median of the low-frequency part."""

    def bits(low: Column) -> Column:
        n = (width >> levels) * (height >> levels)
        s = F.array_sort(low)
        mid = F.element_at(s, n // 2 + 1) if n % 2 else (F.element_at(s, n // 2) + F.element_at(s, n // 2 + 1)) / 2
        return let(F.struct(low.alias("l"), mid.alias("m")), lambda x: pack(F.transform(x["l"], lambda v: v > x["m"])))

    return let(haar_low(p, width, height, levels), bits)


# Transforms


def _weighted(p: Column, weights) -> Column:
    return _sum(F.zip_with(p, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w))


def dct1(x: Column, n: int, keep: int | None = None) -> Column:
    """The first `keep` orthonormal DCT-II coefficients."""
    basis = im.dct_matrix(n)
    return F.array(*[_weighted(x, basis[k]) for k in range(keep or n)])


def dct2(p: Column, width: int, height: int, keep: int) -> Column:
    """The keep x keep lowest frequencies, in doubles: one axis after the other."""
    across, down = im.dct_matrix(width), im.dct_matrix(height)
    weights = lambda rows: F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.slice(p, y * width + 1, F.lit(width)))
    first = F.transform(rows, lambda row: F.transform(weights(across[:keep]), lambda w: _sum(F.zip_with(row, w, lambda a, b: a * b))))

    def second(t: Column) -> Column:
        column = lambda v: F.transform(t, lambda row: F.element_at(row, v + 1))
        return F.flatten(F.transform(weights(down[:keep]), lambda w: F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda v: _sum(F.zip_with(column(v), w, lambda a, b: a * b)))))

    return let(first, second)


def resample(p: Column, width: int, height: int, to_width: int, to_height: int, interpolation: Interpolation) -> Column:
    """Separable resampling with weights that are constants of the plan."""
    across, down = im.resampling_weights(width, to_width, interpolation), im.resampling_weights(height, to_height, interpolation)
    weights = lambda rows: F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.slice(p, y * width + 1, F.lit(width)))
    first = F.transform(rows, lambda row: F.transform(weights(across), lambda w: _sum(F.zip_with(row, w, lambda a, b: a * b))))

    def second(t: Column) -> Column:
        column = lambda x: F.transform(t, lambda row: F.element_at(row, x + 1))
        at = F.sequence(F.lit(0), F.lit(to_width - 1))
        return F.flatten(F.transform(weights(down), lambda w: F.transform(at, lambda x: to_byte(_sum(F.zip_with(column(x), w, lambda a, b: a * b))))))

    return let(first, second)


def to_byte(v: Column) -> Column:
    """Rounded to 16 bits, then cut to 8."""
    wide = F.floor(v * 257 + 0.5)
    return F.shiftright(F.greatest(F.lit(0), F.least(F.lit(65535), wide)).cast("int"), 8)


# Histograms


def lbp_codes(p: Column, width: int, height: int) -> Column:
    from pixelsieve.kernels.descriptors import LBP_NEIGHBOURS

    def code(v: Column, i: Column) -> Column:
        out = F.lit(0)
        x, y = i % width, F.floor(i / width).cast("int")
        for k, (dx, dy) in enumerate(LBP_NEIGHBOURS):
            inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
            out = out + F.when(inside & (F.try_element_at(p, i + dy * width + dx + 1) >= v), 1 << k).otherwise(0)
        return out

    return F.transform(p, code)


def histogram(values: Column, bins: int) -> Column:
    """How often each of 0 to bins - 1 occurs."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(values, lambda v: v == b)))


def raw_moments(p: Column, width: int) -> Column:
    """A struct of spatial moments up to the third order (m10: first in x)."""

    def moment(i: int, j: int) -> Column:
        term = lambda v, k: v * F.pow(k % width, F.lit(i)) * F.pow(F.floor(k / width), F.lit(j))
        return _sum(F.transform(p, term)).alias(f"m{i}{j}")

    return F.struct(*[moment(i, j) for i in range(4) for j in range(4 - i)])


# Sketches of a histogram of visual words


def minhash(hist: Column, vocabulary: int, size: int) -> Column:
    """As the kernel; products stay below 2**63 for fewer than 2**31 words."""
    from pixelsieve.kernels import descriptors as ds

    words = F.filter(F.transform(hist, lambda c, i: F.when(c > 0, i.cast("long"))), lambda w: w.isNotNull())
    factors = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for a, c in ds.minhash_factors(size)])
    value = lambda f, w: (f["a"] * w + f["c"]) % ds.MINHASH_PRIME
    signature = let(words, lambda ws: F.transform(factors, lambda f: F.least(F.array_min(F.transform(ws, lambda w: value(f, w))), F.lit(ds.MINHASH_PRIME - 1)).cast("double")))
    return F.when(F.exists(hist, lambda c: c > 0), signature).otherwise(F.array_repeat(F.lit(0.0), size))


def simhash(hist: Column, vocabulary: int, bits: int) -> Column:
    from pixelsieve.kernels import descriptors as ds

    signs = ds.simhash_signs(vocabulary, bits).T
    votes = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in signs])
    return pack(F.transform(votes, lambda row: _sum(F.zip_with(hist, row, lambda c, s: c * s)) > 0))


# Projections of pixels and vectors


def normalize(x: Column) -> Column:
    """Scaled to 0..1 by the smallest and the largest value; nulls where all are equal."""
    both = F.struct(x.alias("x"), F.array_min(x).cast("double").alias("lo"), F.array_max(x).cast("double").alias("hi"))
    return let(both, lambda s: F.transform(s["x"], lambda v: F.when(s["hi"] > s["lo"], (v - s["lo"]) / (s["hi"] - s["lo"]))))


def z_score(p: Column) -> Column:
    """Pixels over 255, less their mean, over their standard deviation (1 where that is below 1e-12)."""
    scaled = F.transform(p, lambda v: v / 255.0)

    def centred(x: Column) -> Column:
        return let(F.struct(x.alias("x"), (_sum(x) / F.size(x)).alias("m")), lambda s: F.transform(s["x"], lambda v: v - s["m"]))

    def spread(x: Column) -> Column:
        s = F.sqrt(_sum(F.transform(x, lambda v: v * v)) / F.size(x))
        return let(F.struct(x.alias("x"), F.when(s < 1e-12, 1.0).otherwise(s).alias("s")), lambda t: F.transform(t["x"], lambda v: v / t["s"]))

    return let(let(scaled, centred), spread)


def unit(x: Column) -> Column:
    """Over its Euclidean length; a zero vector stays."""
    norm = F.sqrt(_sum(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return let(F.struct(x.alias("x"), norm.alias("n")), lambda s: F.transform(s["x"], lambda v: F.when(s["n"] > 0, v / s["n"]).otherwise(v.cast("double"))))


def saturate(x: Column) -> Column:
    """Doubles as bytes: rounded half away from 0, cut to 0..255."""
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), round_half_away(v))).cast("int"))


def top_left(p: Column, width: int, to_width: int, to_height: int) -> Column:
    """The first columns of the first rows."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(to_height - 1)), lambda y: F.slice(p, y * width + 1, F.lit(to_width))))


def longest_circular_run(flags: Column, n: int) -> Column:
    """The longest run of true among n flags in a circle, n at most."""
    step = lambda s, f: F.struct(F.when(f, s["run"] + 1).otherwise(0).alias("run"), F.when(f, F.greatest(s["best"], s["run"] + 1)).otherwise(s["best"]).alias("best"))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(F.concat(flags, flags), start, step, lambda s: F.least(s["best"], F.lit(n)))

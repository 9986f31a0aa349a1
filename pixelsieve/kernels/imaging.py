"""Image operations on batches: arrays of shape (n, height, width) or, in colour, (n, height, width, 3).

Constants of a configuration (resampling weights, kernels, bases) are built once per process and reused for
every batch. Where a result depends on single precision, arrays are float32 on purpose.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from pixelsieve.types import Interpolation

# Colour


def to_gray(images: np.ndarray) -> np.ndarray:
    """8-bit luma; gray images are returned as they are."""
    if images.ndim == 3:
        return images
    wide = images.astype(np.int64) * 0x101
    return ((19595 * wide[..., 0] + 38470 * wide[..., 1] + 7471 * wide[..., 2] + (1 << 15)) >> 24).astype(np.uint8)


def in_colour(images: np.ndarray) -> np.ndarray:
    return images if images.ndim == 4 else np.repeat(images[..., None], 3, axis=-1)


def ycrcb(images: np.ndarray) -> np.ndarray:
    """Y, Cr and Cb in 14-bit fixed point."""
    r, g, b = np.moveaxis(in_colour(images).astype(np.int64), -1, 0)
    half = 1 << 13
    y = (4899 * r + 9617 * g + 1868 * b + half) >> 14
    cr = ((r - y) * 11682 + (128 << 14) + half) >> 14
    cb = ((b - y) * 9241 + (128 << 14) + half) >> 14
    return np.clip(np.stack((y, cr, cb), axis=-1), 0, 255).astype(np.uint8)


@functools.lru_cache(maxsize=1)
def _divisors() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, 256)
    scaled = lambda top: np.concatenate(([0], np.floor((top << 12) / i + 0.5))).astype(np.int64)
    return scaled(255), np.concatenate(([0], np.floor((180 << 12) / (6 * i) + 0.5))).astype(np.int64)


def hsv(images: np.ndarray) -> np.ndarray:
    """H (0 to 179), S and V in 12-bit fixed point."""
    r, g, b = np.moveaxis(in_colour(images).astype(np.int64), -1, 0)
    by_value, by_range = _divisors()
    v = np.maximum(np.maximum(r, g), b)
    spread = v - np.minimum(np.minimum(r, g), b)
    s = (spread * by_value[v] + (1 << 11)) >> 12
    h = np.where(v == r, g - b, np.where(v == g, b - r + 2 * spread, r - g + 4 * spread))
    h = (h * by_range[spread] + (1 << 11)) >> 12
    h = np.where(h < 0, h + 180, h)
    return np.stack((np.clip(h, 0, 255), s, v), axis=-1).astype(np.uint8)


def jfif(images: np.ndarray) -> np.ndarray:
    """Y, Cb and Cr as in JFIF files, in 16-bit fixed point."""
    r, g, b = np.moveaxis(in_colour(images).astype(np.int64), -1, 0)
    y = (19595 * r + 38470 * g + 7471 * b + (1 << 15)) >> 16
    cb = (-11056 * r - 21712 * g + 32768 * b + (257 << 15)) >> 16
    cr = (32768 * r - 27440 * g - 5328 * b + (257 << 15)) >> 16
    return np.clip(np.stack((y, cb, cr), axis=-1), 0, 255).astype(np.uint8)


# Resampling


def _cubic(b: float, c: float):
    def at(t: float) -> float:
        if t < 1:
            return ((12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t**2 + (6 - 2 * b)) / 6
        if t < 2:
            return ((-b - 6 * c) * t**3 + (6 * b + 30 * c) * t**2 + (-12 * b - 48 * c) * t + (8 * b + 24 * c)) / 6
        return 0.0

    return at


def _lanczos(lobes: int):
    def at(t: float) -> float:
        if t == 0:
            return 1.0
        if t >= lobes:
            return 0.0
        x = math.pi * t
        return lobes * math.sin(x) * math.sin(x / lobes) / (x * x)

    return at


#: Support and weight by distance.
KERNELS = {
    Interpolation.BILINEAR: (1.0, lambda t: max(0.0, 1 - t)),
    Interpolation.BILINEAR_EXACT: (1.0, lambda t: max(0.0, 1 - t)),
    Interpolation.BICUBIC: (2.0, _cubic(0.0, 0.5)),
    Interpolation.MITCHELL_NETRAVALI: (2.0, _cubic(1 / 3, 1 / 3)),
    Interpolation.LANCZOS2: (2.0, _lanczos(2)),
    Interpolation.LANCZOS3: (3.0, _lanczos(3)),
}


@functools.lru_cache(maxsize=64)
def resampling_weights(source: int, target: int, interpolation: Interpolation) -> np.ndarray:
    """(target, source) weights; each row sums to 1. Shrinking widens the kernel, so that all source pixels count."""
    ratio = source / target
    out = np.zeros((target, source))
    if interpolation == Interpolation.NEAREST:
        out[np.arange(target), (2 * np.arange(target) + 1) * source // (2 * target)] = 1
        return out
    support, weight = KERNELS[interpolation]
    stretch = max(ratio, 1.0)
    for x in range(target):
        centre = (x + 0.5) * ratio - 0.5
        first = max(0, math.floor(centre - support * stretch))
        last = min(source, math.ceil(centre + support * stretch))
        for at in range(first, last):
            t = abs(centre - at) / stretch
            if t < support:
                out[x, at] = weight(t)
        total = out[x].sum()
        if total == 0:
            out[x, min(source - 1, max(0, round(centre)))] = total = 1.0
        out[x] /= total
    return out


def _weighted(x: np.ndarray, weights: np.ndarray, axis: int = -1) -> np.ndarray:
    """Weighted sums along one of the two last axes, term by term in the order of places: a product of matrices may
    add up in any order, and a sum at a tie would be rounded one way or the other."""
    size, place = weights.shape[1], np.arange(len(weights))
    first = (weights != 0).argmax(axis=1)
    last = size - 1 - (weights[:, ::-1] != 0).argmax(axis=1)
    out = 0.0
    for k in range(int((last - first).max()) + 1):
        at = np.minimum(first + k, size - 1)
        by = np.where(first + k <= last, weights[place, at], 0.0)
        term = np.take(x, at, axis=axis)
        term *= by if axis == -1 else by[:, None]
        if k:
            out += term
        else:
            out = term + 0.0
    return out


def resize(images: np.ndarray, width: int, height: int, interpolation: Interpolation) -> np.ndarray:
    """Separable resampling, in doubles, rounded to 16 bits and cut to 8."""
    h, w = images.shape[1:3]
    if interpolation == Interpolation.NEAREST:
        rows = (2 * np.arange(height) + 1) * h // (2 * height)
        columns = (2 * np.arange(width) + 1) * w // (2 * width)
        return images[:, rows][:, :, columns]
    across, down = resampling_weights(w, width, interpolation), resampling_weights(h, height, interpolation)
    planes = np.moveaxis(in_colour(images), -1, 1) if images.ndim == 4 else images
    wide = _weighted(_weighted(planes.astype(np.float64), across), down, -2)
    wide *= 0x101
    wide += 0.5
    out = (np.clip(np.floor(wide, out=wide), 0, 0xFFFF, out=wide).astype(np.uint16) >> 8).astype(np.uint8)
    return np.moveaxis(out, 1, -1) if images.ndim == 4 else out


# Filters

#: Small Gaussian kernels, fixed values.
_SMALL = {
    1: (1.0,),
    3: (0.25, 0.5, 0.25),
    5: (0.0625, 0.25, 0.375, 0.25, 0.0625),
    7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125),
}


def round_half_away(x):
    return np.trunc(x + np.copysign(0.5, x))


@functools.lru_cache(maxsize=32)
def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    """float32 weights that sum to 1."""
    if sigma <= 0 and size in _SMALL:
        raw = np.array(_SMALL[size], np.float32)
    else:
        spread = sigma if sigma > 0 else ((size - 1) * 0.5 - 1) * 0.3 + 0.8
        x = np.arange(size) - (size - 1) * 0.5
        raw = np.exp(-0.5 / (spread * spread) * x * x).astype(np.float32)
    return (raw.astype(np.float64) * (1 / raw.astype(np.float64).sum())).astype(np.float32)


def blur_taps(size: int, sigma: float) -> np.ndarray:
    """Weights in 1/256, cut to whole numbers; size 0 is chosen by sigma."""
    if size == 0:
        size = int(round_half_away(sigma * 6 + 1)) | 1
    return (gaussian_kernel(size, sigma) * np.float32(256)).astype(np.int64)


def _one_axis(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Weighted neighbours along an axis. A neighbour i steps before the start is replaced by the pixel i steps
    after it, whatever the pixel in the middle; likewise at the end."""
    n, mid = x.shape[axis], (len(taps) - 1) // 2
    at = np.arange(n)
    out = x * taps[mid]
    for i in range(1, mid + 1):
        before = np.where(at - i < 0, i, at - i)
        after = np.where(at + i >= n, n - 1 - i, at + i)
        out = out + np.take(x, before, axis=axis) * taps[mid - i] + np.take(x, after, axis=axis) * taps[mid + i]
    return out


def gaussian_blur(images: np.ndarray, size: int, sigma: float) -> np.ndarray:
    taps = blur_taps(size, sigma)
    sums = _one_axis(_one_axis(images.astype(np.int64), taps, 2), taps, 1)
    return np.clip((sums + (1 << 15)) >> 16, 0, 255).astype(np.uint8)


def reflect(index: np.ndarray, size: int) -> np.ndarray:
    """Mirrors indexes at the ends, without doubling the end, as often as needed."""
    if size <= 1:
        return np.zeros_like(index)
    index = np.abs(index) % (2 * (size - 1))
    return np.where(index < size, index, 2 * (size - 1) - index)


def correlate(images: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Dense correlation with mirrored borders; float32 results of double sums."""
    kh, kw = kernel.shape
    h, w = images.shape[1:]
    rows, columns = reflect(np.arange(-(kh // 2), h + kh // 2), h), reflect(np.arange(-(kw // 2), w + kw // 2), w)
    padded = images[:, rows][:, :, columns].astype(np.float64)
    out = np.zeros(images.shape)
    for i in range(kh):
        for j in range(kw):
            out += padded[:, i : i + h, j : j + w] * float(kernel[i, j])
    return out.astype(np.float32)


def equalize(images: np.ndarray) -> np.ndarray:
    """Histogram equalisation; the darkest occurring value becomes 0."""
    n, h, w = images.shape
    flat = images.reshape(n, -1)
    out = np.empty_like(flat)
    for k in range(n):
        count = np.bincount(flat[k], minlength=256)
        first = int(np.argmax(count > 0))
        rest = h * w - count[first]
        above = np.cumsum(count) - count[: first + 1].sum()
        scale = np.float32(255.0) / np.float32(rest) if rest else np.float32(0)
        lut = np.clip(round_half_away(above.astype(np.float32) * scale), 0, 255)
        lut[: first + 1] = 0
        out[k] = lut.astype(np.uint8)[flat[k]]
    return out.reshape(images.shape)


def jarosz(planes: np.ndarray, half: int, times: int) -> np.ndarray:
    """Running box means, float32, in place along rows and then columns: the trailing edge leaves with its mean,
    not with its value, the leading edge beyond the end is 0."""
    out = planes.astype(np.float32).copy()
    for axis in (2, 1):
        x = np.moveaxis(out, axis, 0)
        width, n = np.float32(2 * half + 1), x.shape[0]
        for _ in range(times):
            s = x[0] * np.float32(half)
            for j in range(1, min(half, n - 1) + 1):
                s = s + x[j]
            s = s + x[0]
            x[0] = s / width
            zero = np.zeros_like(x[0])
            for j in range(1, n):
                lead = x[j + half] if j + half < n else zero
                trail = x[j - half - 1] if j - half - 1 >= 0 else zero
                s = s + (lead - trail)
                x[j] = s / width
    return out


# Transforms


@functools.lru_cache(maxsize=16)
def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II."""
    k = np.arange(n)
    c = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * math.sqrt(2 / n)
    c[0] = math.sqrt(1 / n)
    return c


def dct2(planes: np.ndarray, corner: int | None = None) -> np.ndarray:
    """The two-dimensional DCT, or only its lowest frequencies; single precision in and out."""
    h, w = planes.shape[1:]
    rows, columns = dct_matrix(h)[:corner], dct_matrix(w)[:corner]
    return (rows @ (planes.astype(np.float32).astype(np.float64) @ columns.T)).astype(np.float32)


def haar_low(planes: np.ndarray, levels: int) -> np.ndarray:
    """The low-frequency part after so many Haar steps (means of two, in float32)."""
    x = planes.astype(np.float32)
    for _ in range(levels):
        if x.shape[1] < 2 or x.shape[2] < 2:
            break
        h, w = x.shape[1] // 2 * 2, x.shape[2] // 2 * 2
        x = (x[:, :, 0:w:2] + x[:, :, 1:w:2]) / np.float32(2)
        x = (x[:, 0:h:2] + x[:, 1:h:2]) / np.float32(2)
    return x


# Statistics


def gray_mean(images: np.ndarray) -> np.ndarray:
    return images.reshape(len(images), -1).mean(axis=1)


def gray_median(images: np.ndarray) -> np.ndarray:
    """The middle value; for an even count the mean of the values one before and one after the upper middle."""
    s = np.sort(images.reshape(len(images), -1), axis=1).astype(np.float64)
    n = s.shape[1]
    return s[:, n // 2] if n % 2 else (s[:, n // 2 - 1] + s[:, n // 2 + 1]) / 2


def median32(x: np.ndarray) -> np.ndarray:
    """The usual median of each row, in float32."""
    s = np.sort(x, axis=1)
    n = s.shape[1]
    return s[:, n // 2] if n % 2 else (s[:, n // 2 - 1] + s[:, n // 2]) / np.float32(2)


def raw_moments(planes: np.ndarray) -> dict[str, np.ndarray]:
    """Spatial moments up to the third order about pixel indexes, by name (m10: first in x)."""
    p = planes.astype(np.float64)
    x, y = np.arange(p.shape[2], dtype=np.float64), np.arange(p.shape[1], dtype=np.float64)
    by_power = [p @ x**i for i in range(4)]
    return {f"m{i}{j}": by_power[i] @ y**j for i in range(4) for j in range(4 - i)}


def normalised_moments(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Central moments over powers of the mass; all 0 without mass."""
    some = np.abs(m["m00"]) > np.finfo(np.float64).eps
    inv = np.where(some, 1 / np.where(some, m["m00"], 1.0), 0.0)
    cx, cy = m["m10"] * inv, m["m01"] * inv
    mu20 = m["m20"] - m["m10"] * cx
    mu11 = m["m11"] - m["m10"] * cy
    mu02 = m["m02"] - m["m01"] * cy
    mu = {
        "20": mu20,
        "11": mu11,
        "02": mu02,
        "30": m["m30"] - cx * (3 * mu20 + cx * m["m10"]),
        "21": m["m21"] - cx * (2 * mu11 + cx * m["m01"]) - cy * mu20,
        "12": m["m12"] - cy * (2 * mu11 + cy * m["m10"]) - cx * mu02,
        "03": m["m03"] - cy * (3 * mu02 + cy * m["m01"]),
    }
    second = inv * inv
    third = second * np.sqrt(np.abs(inv))
    return {k: v * (second if k in ("20", "11", "02") else third) for k, v in mu.items()}


def hu_moments(planes: np.ndarray) -> np.ndarray:
    """Seven invariants of each plane."""
    nu = normalised_moments(raw_moments(planes))
    a, b = nu["30"] + nu["12"], nu["21"] + nu["03"]
    c, d = nu["30"] - 3 * nu["12"], 3 * nu["21"] - nu["03"]
    e, f = nu["20"] - nu["02"], 4 * nu["11"]
    g, k = a * (a * a - 3 * b * b), b * (3 * a * a - b * b)
    return np.stack(
        (nu["20"] + nu["02"], e * e + f * nu["11"], c * c + d * d, a * a + b * b, c * g + d * k, e * (a * a - b * b) + f * a * b, d * g - c * k),
        axis=1,
    )


# Bits


def pack_bits(bits: np.ndarray, first_low: bool = True) -> np.ndarray:
    """Bits of each row in bytes, from each byte's lowest (or highest) bit on; spare bits are 0."""
    return np.packbits(bits.astype(bool), axis=1, bitorder="little" if first_low else "big")

"""From gray or colour batches to hashes. Each function returns a row of bytes or doubles for each image."""

from __future__ import annotations

import functools
import math

import numpy as np

from pixelsieve.kernels import imaging as im
from pixelsieve.types import Feature, Storage

# Thresholds


def mean_bits(gray: np.ndarray) -> np.ndarray:
    flat = gray.reshape(len(gray), -1)
    return im.pack_bits(flat > im.round_half_away(im.gray_mean(gray))[:, None])


def median_bits(gray: np.ndarray) -> np.ndarray:
    flat = gray.reshape(len(gray), -1)
    return im.pack_bits(flat > im.round_half_away(im.gray_median(gray))[:, None])


def rising_bits(gray: np.ndarray) -> np.ndarray:
    """Whether each pixel is brighter than its left neighbour."""
    return im.pack_bits((gray[:, :, 1:] > gray[:, :, :-1]).reshape(len(gray), -1))


def dct_bits(gray: np.ndarray) -> np.ndarray:
    """64 low frequencies without the mean, against their mean in single precision."""
    low = im.dct2(gray, 8).reshape(len(gray), 64).copy()
    low[:, 0] = 0
    total = np.zeros(len(gray), np.float32)
    for k in range(64):
        total = total + low[:, k]
    return im.pack_bits(low > (total / np.float32(64))[:, None])


def haar_bits(gray: np.ndarray, levels: int) -> np.ndarray:
    low = im.haar_low(gray, levels).reshape(len(gray), -1)
    return im.pack_bits(low > im.median32(low)[:, None])


def pdq_bits(gray: np.ndarray) -> np.ndarray:
    low = im.dct2(im.jarosz(gray, 2, 2), 16).reshape(len(gray), 256)
    return im.pack_bits(low > im.median32(low)[:, None])


# Blocks


def block_means(gray: np.ndarray, bw: int, bh: int, overlap: bool) -> np.ndarray:
    """Means of blocks in row-major order; with overlap a block starts every half block."""
    n, h, w = gray.shape
    columns, rows, dx, dy = w // bw, h // bh, bw, bh
    if overlap:
        columns, rows, dx, dy = 2 * columns - 1, 2 * rows - 1, bw // 2, bh // 2
    sums = np.zeros((n, h + 1, w + 1))
    sums[:, 1:, 1:] = gray.cumsum(axis=1, dtype=np.int64).cumsum(axis=2)
    y, x = (np.arange(rows) * dy)[:, None], (np.arange(columns) * dx)[None, :]
    y2, x2 = np.minimum(y + bh, h), np.minimum(x + bw, w)
    total = sums[:, y2, x2] - sums[:, y, x2] - sums[:, y2, x] + sums[:, y, x]
    return (total / ((y2 - y) * (x2 - x))).reshape(n, -1)


@functools.lru_cache(maxsize=8)
def _turned(h: int, w: int, degrees: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the place it is read from, and whether that is inside."""
    a = degrees * math.pi / 180
    cos, sin, cx, cy = math.cos(a), math.sin(a), (w - 1) / 2, (h - 1) / 2
    fx, fy = np.arange(w)[None, :] - cx, np.arange(h)[:, None] - cy
    x = im.round_half_away(cos * fx + sin * fy + cx).astype(np.int64)
    y = im.round_half_away(-sin * fx + cos * fy + cy).astype(np.int64)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return np.where(inside, y * w + x, 0), inside


def rotate(gray: np.ndarray, degrees: int) -> np.ndarray:
    """About the centre, cropped, nearest pixels, 0 outside."""
    place, inside = _turned(*gray.shape[1:], degrees)
    return np.where(inside, gray.reshape(len(gray), -1)[:, place], 0).astype(np.uint8)


def block_bits(gray: np.ndarray, bw: int, bh: int, overlap: bool, turns: int = 1) -> np.ndarray:
    """Blocks at least as bright as the image; for each of the turns, bits follow bits."""
    parts = []
    for d in range(turns):
        turned = rotate(gray, 15 * d) if d else gray
        parts.append(block_means(turned, bw, bh, overlap) >= im.gray_mean(turned)[:, None])
    return im.pack_bits(np.concatenate(parts, axis=1))


@functools.lru_cache(maxsize=8)
def marr_hildreth_kernel(scale: float, alpha: float) -> np.ndarray:
    reach = int(4 * alpha**scale)
    step = (np.float32(alpha**-scale) * np.arange(-reach, reach + 1).astype(np.float32)).astype(np.float32)
    a = (step[None, :] * step[None, :] + (step * step)[:, None]).astype(np.float64)
    return ((2 - a) * np.exp(-a / 2)).astype(np.float32)


MH_BLOCKS, MH_SIDE = 31, 16


@functools.lru_cache(maxsize=8)
def _marr_hildreth_sums(size: int, scale: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that filter one axis and add up its blocks: the kernel (2 - x² - y²) exp(-x²/2) exp(-y²/2) is
    the sum of two products of one factor an axis."""
    reach = int(4 * alpha**scale)
    step = np.float32(alpha**-scale) * np.arange(-reach, reach + 1).astype(np.float32)
    x = step.astype(np.float64)
    out = []
    for taps in (np.exp(-x * x / 2), x * x * np.exp(-x * x / 2)):
        m = np.zeros((MH_BLOCKS, size))
        for at in range(MH_BLOCKS * MH_SIDE):
            np.add.at(m[at // MH_SIDE], im.reflect(np.arange(at - reach, at + reach + 1), size), taps)
        out.append(m)
    return out[0], out[1]


def marr_hildreth_bits(equalized: np.ndarray, scale: float, alpha: float) -> np.ndarray:
    """Sums of 31 x 31 blocks of the filtered image, each 3 x 3 neighbourhood against its mean."""
    p = equalized.astype(np.float64)
    gy, ky = _marr_hildreth_sums(p.shape[1], scale, alpha)
    gx, kx = _marr_hildreth_sums(p.shape[2], scale, alpha)
    half = gy @ p
    blocks = (2 * (half @ gx.T) - ky @ p @ gx.T - half @ kx.T).astype(np.float32)
    bits = []
    for r in range(0, MH_BLOCKS - 2, 4):
        for c in range(0, MH_BLOCKS - 2, 4):
            part = np.swapaxes(blocks[:, c : c + 3, r : r + 3], 1, 2).reshape(len(p), 9)
            total = np.zeros(len(p), np.float32)
            for k in range(9):
                total = total + part[:, k]
            bits.append(part > (total / np.float32(9))[:, None])
    return im.pack_bits(np.concatenate(bits, axis=1), first_low=False)


# Rings and rays


@functools.lru_cache(maxsize=8)
def _ring_of(h: int, w: int, rings: int) -> np.ndarray:
    cx, cy = w / 2, h / 2
    radius = min(cx, cy)
    y, x = np.arange(h)[:, None] + 0.5 - cy, np.arange(w)[None, :] + 0.5 - cx
    return np.minimum(rings - 1, (np.sqrt(x * x + y * y) / (radius / rings)).astype(np.int64)).ravel()


def ring_means(gray: np.ndarray, rings: int) -> np.ndarray:
    """The mean of each ring about the centre; what lies outside counts to the last, an empty ring is 0."""
    ring = _ring_of(*gray.shape[1:], rings)
    count = np.bincount(ring, minlength=rings)
    sums = np.array([np.bincount(ring, x, rings) for x in gray.reshape(len(gray), -1).astype(np.float64)]).reshape(len(gray), rings)
    return np.where(count > 0, sums / np.maximum(count, 1), 0.0)


def ring_bits(gray: np.ndarray, rings: int) -> np.ndarray:
    keep = min(64, rings - 1)
    c = (ring_means(gray, rings) @ im.dct_matrix(rings).T)[:, 1 : keep + 1]
    if not keep:
        return np.zeros((len(gray), 0), np.uint8)
    return im.pack_bits(c > np.sort(c, axis=1)[:, keep // 2][:, None])


@functools.lru_cache(maxsize=8)
def _rays(h: int, w: int, angles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of each line: their slot (line, x), the pixel, and the number of samples by line."""
    side = max(h, w)
    x_mid, y_mid = w // 2, h // 2
    found: dict[int, int] = {}
    count = np.zeros(angles, np.int64)

    def put(line: int, x: int, row: int, column: int) -> None:
        found[line * side + x] = row * w + column
        count[line] += 1

    def slope(k: int) -> np.ndarray:
        t = np.float32(math.tan(float(np.float32(np.float32(k) * np.float32(math.pi) / np.float32(angles)))))
        y = t * (np.arange(side) - x_mid).astype(np.float32)
        return np.floor((y + np.where(y >= 0, np.float32(0.5), np.float32(-0.5))).astype(np.float64)).astype(int)

    for k in range(angles // 4 + 1):
        for x, d in enumerate(slope(k).tolist()):
            if 0 <= d + y_mid < h and x < w:
                put(k, x, d + y_mid, x)
            if 0 <= d + x_mid < w and k != angles // 4 and x < h:
                put(angles // 2 - k, x, x, d + x_mid)
    start = 3 * angles // 4
    for k in range(start, angles):
        for x, d in enumerate(slope(k).tolist()):
            if 0 <= d + y_mid < h and x < w:
                put(k, x, d + y_mid, x)
            # the mirrored line: its column is tested against the width with the row's offset
            if 0 <= y_mid - d < w and 0 <= 2 * y_mid - x < h and k != start:
                put(k - 2 * (k - start), x, 2 * y_mid - x, y_mid - d)
    return np.array(list(found), np.int64), np.array(list(found.values()), np.int64), count


def radial_features(gray: np.ndarray, angles: int) -> np.ndarray:
    """The variance along each line, standardised over the lines."""
    n, h, w = gray.shape
    slot, pixel, count = _rays(h, w, angles)
    line = slot // max(h, w)
    v = gray.reshape(n, -1)[:, pixel].astype(np.float64)
    adds = np.zeros((len(slot), angles))
    adds[np.arange(len(slot)), line] = 1
    size = count + 1e-5
    feature = (v * v) @ adds / size - ((v @ adds) / size) ** 2
    mean = feature.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.sqrt((feature * feature).mean(axis=1, keepdims=True) - mean**2)
        return (feature - mean) / spread


def radial_scaled(gray: np.ndarray, angles: int, size: int = 40) -> np.ndarray:
    """The low frequencies of the features, on a scale from 0 to 255; zeros for images without any."""
    f = radial_features(gray, angles)
    k, j = np.arange(size)[:, None], np.arange(angles)[None, :]
    basis = np.cos(np.pi * (2 * j + 1) * k / (2 * angles)) * np.where(k == 0, 1, math.sqrt(2)) / math.sqrt(angles)
    c = f @ basis.T
    bad = ~np.isfinite(c).all(axis=1)
    c[bad] = 0
    high, low = np.maximum(c.max(axis=1), 0)[:, None], np.minimum(c.min(axis=1), 0)[:, None]
    range_ = np.where(high > low, high - low, 1.0)
    return np.where(high > low, 255 * (c - low) / range_, 0)


def radial_bytes(gray: np.ndarray, angles: int, size: int = 40) -> np.ndarray:
    return radial_scaled(gray, angles, size).astype(np.uint8)


# Layout and edges

#: Zig-zag order of an 8 x 8 block's first coefficients (row-major places), as in JPEG. Fixed values.
ZIGZAG = (0, 1, 8, 16, 9, 2)
CLD_COEFFICIENTS = (6, 3, 3)


def _cells(n: int, grid: int) -> list[tuple[int, int]]:
    out = []
    for g in range(grid):
        lo, hi = g * n // grid, (g + 1) * n // grid
        out.append((lo, max(hi, lo + 1)) if lo < n else (n - 1, n))
    return out


def layout_bytes(images: np.ndarray) -> np.ndarray:
    """Quantised low frequencies of the 8 x 8 mean colours."""
    planes = np.moveaxis(im.jfif(images), -1, 1).astype(np.float64)
    rows, columns = _cells(planes.shape[2], 8), _cells(planes.shape[3], 8)
    means = np.stack([np.stack([planes[:, :, a:b, c:d].mean(axis=(2, 3)) for c, d in columns], axis=-1) for a, b in rows], axis=-2)
    out = []
    for plane, keep in enumerate(CLD_COEFFICIENTS):
        c = im.dct2(means[:, plane]).reshape(len(images), 64).astype(np.float64)
        for k, place in enumerate(ZIGZAG[:keep]):
            if k == 0:
                # the first coefficient is eight times the mean
                out.append(np.clip(im.round_half_away(c[:, 0] / 8 * 63 / 255), 0, 63))
            else:
                out.append(np.clip(im.round_half_away(c[:, place] / 16) + 16, 0, 31))
    return np.stack(out, axis=1).astype(np.uint8)


#: Centroids of the MPEG-7 edge histogram's bins, by edge type: vertical, horizontal, 45 and 135 degrees, none. Fixed values.
EDGE_CENTROIDS = np.array([
    [0.010867, 0.057915, 0.099526, 0.144849, 0.195573, 0.260504, 0.358031, 0.530128],
    [0.012266, 0.069934, 0.125879, 0.182307, 0.243396, 0.314563, 0.411728, 0.564319],
    [0.004193, 0.025852, 0.046860, 0.068519, 0.093286, 0.123490, 0.161505, 0.228960],
    [0.004174, 0.025924, 0.046232, 0.067163, 0.089655, 0.115391, 0.151904, 0.217745],
    [0.006778, 0.051667, 0.108650, 0.166257, 0.224226, 0.285691, 0.356375, 0.450972],
])
EDGE_THRESHOLD = 11.0


def edge_shares(gray: np.ndarray) -> np.ndarray:
    """For each of 4 x 4 cells the share of its 2 x 2 blocks with each of five edge types: (n, 16, 5)."""
    p = gray.astype(np.float64)
    out = np.zeros((len(p), 16, 5))
    for y, (top, bottom) in enumerate(_cells(p.shape[1], 4)):
        for x, (left, right) in enumerate(_cells(p.shape[2], 4)):
            rows, columns = (bottom - top) // 2 * 2, (right - left) // 2 * 2
            if not rows or not columns:
                continue
            cell = p[:, top : top + rows, left : left + columns]
            a, b, c, d = cell[:, ::2, ::2], cell[:, ::2, 1::2], cell[:, 1::2, ::2], cell[:, 1::2, 1::2]
            response = np.abs(np.stack((a - b + c - d, a + b - c - d, math.sqrt(2) * (a - d), math.sqrt(2) * (b - c), 2 * (a - b - c + d)), axis=-1))
            best = response.argmax(axis=-1)
            strong = response.max(axis=-1) >= EDGE_THRESHOLD
            for k in range(5):
                out[:, 4 * y + x, k] = ((best == k) & strong).mean(axis=(1, 2))
    return out


def edge_bytes(gray: np.ndarray) -> np.ndarray:
    shares = edge_shares(gray)
    return np.abs(shares[..., None] - EDGE_CENTROIDS).argmin(axis=-1).reshape(len(gray), 80).astype(np.uint8)


# Texture and gradients

#: Neighbours by bit, (x, y): from the right, clockwise. Fixed values.
LBP_NEIGHBOURS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def lbp_codes(gray: np.ndarray) -> np.ndarray:
    """A bit for each neighbour that is at least as bright; none for those outside."""
    n, h, w = gray.shape
    wide = np.full((n, h + 2, w + 2), -1, np.int16)
    wide[:, 1:-1, 1:-1] = gray
    out = np.zeros(gray.shape, np.uint8)
    for k, (dx, dy) in enumerate(LBP_NEIGHBOURS):
        out |= ((wide[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] >= gray) << k).astype(np.uint8)
    return out


def _scaled(hist: np.ndarray) -> np.ndarray:
    top = hist.max(axis=-1, keepdims=True)
    return np.where(top > 0, hist * 255.0 / np.where(top > 0, top, 1), 0)


def lbp_bytes(gray: np.ndarray, gx: int, gy: int) -> np.ndarray:
    """Histograms of codes by cell, scaled to the largest bin; the last cells take what is left over."""
    codes = lbp_codes(gray)
    n, h, w = gray.shape
    cw, ch = w // gx, h // gy
    out = np.zeros((n, gy, gx, 256))
    for y in range(gy):
        for x in range(gx):
            cell = codes[:, y * ch : h if y == gy - 1 else (y + 1) * ch, x * cw : w if x == gx - 1 else (x + 1) * cw].reshape(n, -1)
            for k in range(n):
                out[k, y, x] = np.bincount(cell[k], minlength=256)
    return _scaled(out).astype(np.uint8).reshape(n, -1)


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and angle (degrees, 0 to below 180) of central differences, one-sided at the borders."""
    wide = np.pad(gray.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    dx, dy = wide[:, 1:-1, 2:] - wide[:, 1:-1, :-2], wide[:, 2:, 1:-1] - wide[:, :-2, 1:-1]
    angle = np.arctan2(dy, dx) * 180 / np.pi
    angle = np.where(angle < 0, angle + 180, angle)
    return np.sqrt(dx * dx + dy * dy), np.where(angle >= 180, 0.0, angle)


def gradient_bytes(gray: np.ndarray, cell: int, bins: int) -> np.ndarray:
    """Histograms of angles by cell, weighted with magnitude; pixels beyond the last whole cell don't count."""
    magnitude, angle = gradients(gray)
    n, h, w = gray.shape
    columns, rows = max(1, w // cell), max(1, h // cell)
    bin_ = np.minimum(bins - 1, (angle / (180.0 / bins)).astype(np.int64))
    y, x = np.arange(h) // cell, np.arange(w) // cell
    place = (y[:, None] * columns + x[None, :])[None] * bins + bin_
    inside = np.broadcast_to((y[:, None] < rows) & (x[None, :] < columns), gray.shape)
    hist = np.zeros((n, rows * columns * bins))
    for k in range(n):
        hist[k] = np.bincount(place[k][inside[k]], magnitude[k][inside[k]], rows * columns * bins)
    return _scaled(hist.reshape(n, -1, bins)).astype(np.uint8).reshape(n, -1)


# Moments


def colour_moments(images: np.ndarray) -> np.ndarray:
    """Seven invariants each of H, S, V, Y, Cr and Cb."""
    planes = np.concatenate((im.hsv(images), im.ycrcb(images)), axis=-1)
    return np.concatenate([im.hu_moments(planes[..., k]) for k in range(6)], axis=1)


@functools.lru_cache(maxsize=8)
def zernike_orders(degree: int) -> tuple[tuple[int, int], ...]:
    return tuple((n, m) for n in range(degree + 1) for m in range(n % 2, n + 1, 2))


@functools.lru_cache(maxsize=8)
def _zernike_basis(h: int, w: int, degree: int) -> np.ndarray:
    """(pixels, orders) complex values of the conjugate polynomials on the unit disc, 0 outside."""
    radius = min(w, h) / 2
    y, x = (np.arange(h)[:, None] - (h - 1) / 2) / radius, (np.arange(w)[None, :] - (w - 1) / 2) / radius
    rho2 = x * x + y * y
    rho, theta = np.sqrt(rho2), np.arctan2(y + 0 * x, x + 0 * y)
    out = []
    for n, m in zernike_orders(degree):
        radial = np.zeros((h, w))
        for s in range((n - m) // 2 + 1):
            c = math.factorial(n - s) / (math.factorial(s) * math.factorial((n + m) // 2 - s) * math.factorial((n - m) // 2 - s))
            radial += (-1) ** s * c * rho ** (n - 2 * s)
        out.append(np.where(rho2 <= 1, radial * np.exp(-1j * m * theta), 0).ravel())
    return np.array(out).T


def zernike_magnitudes(gray: np.ndarray, degree: int) -> np.ndarray:
    """Magnitudes over that of order (0, 0); zeros for a black image."""
    orders = zernike_orders(degree)
    sums = (gray.reshape(len(gray), -1) / 255) @ _zernike_basis(*gray.shape[1:], degree)
    size = np.abs(sums) * (np.array([n for n, _ in orders]) + 1) / np.pi
    some = size[:, :1] > 1e-12
    return np.where(some, size[:, 1:] / np.where(some, size[:, :1], 1), 0.0)


#: Wavelength and number of orientations of each scale of the Gabor bank. Fixed values.
GABOR_SCALES = ((4.0, 8), (8.0, 8), (12.0, 4))


@functools.lru_cache(maxsize=1)
def gabor_bank() -> tuple[tuple[np.ndarray, ...], ...]:
    """By scale, the filters of all its orientations as complex arrays of unit energy."""
    out = []
    for wavelength, orientations in GABOR_SCALES:
        sigma = 0.56 * wavelength
        reach = min(9, max(3, math.ceil(2 * sigma)))
        y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
        scale = []
        for o in range(orientations):
            t = o * math.pi / orientations
            u, v = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
            f = np.exp(-(u * u + 0.25 * v * v) / (2 * sigma * sigma)) * np.exp(2j * math.pi * u / wavelength)
            scale.append(f / math.sqrt((np.abs(f) ** 2).sum()))
        out.append(tuple(scale))
    return tuple(out)


def gist(gray: np.ndarray, gx: int, gy: int) -> np.ndarray:
    """Mean filter energy by scale, orientation and cell, as a unit vector."""
    n, h, w = gray.shape
    x = gray / 255.0
    x = x - x.mean(axis=(1, 2), keepdims=True)
    spread = x.std(axis=(1, 2), keepdims=True)
    x = x / np.where(spread < 1e-12, 1.0, spread)
    cell = ((np.arange(h) * gy // h)[:, None] * gx + (np.arange(w) * gx // w)[None, :]).ravel()
    count = np.bincount(cell, minlength=gx * gy)
    pool = np.zeros((h * w, gx * gy))
    pool[np.arange(h * w), cell] = 1 / count[cell]
    out = [[] for _ in range(n)]
    for scale in gabor_bank():
        reach = scale[0].shape[0] // 2
        rows, columns = im.reflect(np.arange(-reach, h + reach), h), im.reflect(np.arange(-reach, w + reach), w)
        bank = np.array([f.ravel() for f in scale])
        bank = np.concatenate((bank.real, bank.imag)).T
        for k in range(n):
            wide = np.ascontiguousarray(x[k][rows][:, columns])
            views = np.lib.stride_tricks.sliding_window_view(wide, (2 * reach + 1, 2 * reach + 1)).reshape(h * w, -1)
            both = views @ bank
            energy = np.hypot(both[:, : len(scale)], both[:, len(scale) :])
            out[k].append((energy.T @ pool).ravel())
    flat = np.array([np.concatenate(parts) for parts in out]).reshape(n, -1)
    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(norm > 0, norm, 1)


# Local features

_M64 = (1 << 64) - 1


def mix64(x: int) -> int:
    """The finaliser of SplitMix64, with its step."""
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


@functools.lru_cache(maxsize=4)
def sampling_pairs(radius: int, seed: int) -> np.ndarray:
    """256 pairs of offsets (x1, y1, x2, y2) within a radius."""
    out, s = [], seed
    for _ in range(256 * 4):
        s = mix64(s)
        out.append(s % (2 * radius + 1) - radius)
    return np.array(out).reshape(256, 4)


#: By feature: border and orientation radius, sampling radius and seed. Fixed values.
FEATURES = {Feature.ORB: (8, 15, 0x6A09E667F3BCC909), Feature.AKAZE: (10, 19, 0xBB67AE8584CAA73B)}
AKAZE_SCALES = (1.0, 1.6, 2.2)
FAST_THRESHOLD = 20
#: Circle of radius 3 about a pixel, (x, y), clockwise from above. Fixed values.
FAST_CIRCLE = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))


def fast_responses(gray: np.ndarray) -> np.ndarray:
    """For one image: the sum of differences to the circle, where nine neighbours in a row on it are all much
    brighter or all much darker; else 0."""
    h, w = gray.shape
    out = np.zeros((h, w))
    if h < 7 or w < 7:
        return out
    p = gray.astype(np.int64)
    centre = p[3 : h - 3, 3 : w - 3]
    ring = np.stack([p[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dx, dy in FAST_CIRCLE])

    def in_a_row(mask: np.ndarray) -> np.ndarray:
        twice = np.concatenate((mask, mask[:8]))
        return np.any([twice[k : k + 9].all(axis=0) for k in range(16)], axis=0)

    ok = in_a_row(ring >= centre + FAST_THRESHOLD) | in_a_row(ring <= centre - FAST_THRESHOLD)
    out[3 : h - 3, 3 : w - 3] = np.where(ok, np.abs(ring - centre).sum(axis=0), 0)
    return out


def hessian_responses(gray: np.ndarray) -> np.ndarray:
    """For one image: the largest scaled determinant of second differences that no neighbouring scale exceeds."""
    h, w = gray.shape
    out = np.zeros((h, w))
    if h < 7 or w < 7:
        return out
    scales = []
    for sigma in AKAZE_SCALES:
        p = im.gaussian_blur(gray[None], 0, sigma)[0].astype(np.float64)
        r = np.zeros((h, w))
        mid = p[1:-1, 1:-1]
        dxx, dyy = p[1:-1, 2:] + p[1:-1, :-2] - 2 * mid, p[2:, 1:-1] + p[:-2, 1:-1] - 2 * mid
        dxy = (p[2:, 2:] - p[2:, :-2] - p[:-2, 2:] + p[:-2, :-2]) * 0.25
        r[1:-1, 1:-1] = np.abs(dxx * dyy - dxy * dxy) * sigma * sigma
        scales.append(r)
    for k, r in enumerate(scales):
        peak = np.ones((h, w), bool)
        for other in (k - 1, k + 1):
            if 0 <= other < len(scales):
                peak &= scales[other] <= r
        out = np.maximum(out, np.where(peak, r, 0))
    inner = np.zeros((h, w), bool)
    inner[3 : h - 3, 3 : w - 3] = True
    return np.where(inner, out, 0)


def keypoints(gray: np.ndarray, feature: Feature, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, response and orientation of the strongest strict local maxima, strongest first, then by y and x."""
    radius = FEATURES[feature][0]
    r = fast_responses(gray) if feature == Feature.ORB else hessian_responses(gray)
    h, w = r.shape
    wide = np.full((h + 2, w + 2), -1.0)
    wide[1:-1, 1:-1] = r
    peak = r > 0
    for dy in range(3):
        for dx in range(3):
            if (dx, dy) != (1, 1):
                peak &= wide[dy : dy + h, dx : dx + w] < r
    inner = np.zeros_like(peak)
    inner[radius : h - radius, radius : w - radius] = True
    y, x = np.nonzero(peak & inner)
    order = np.lexsort((x, y, -r[y, x]))[:most]
    y, x = y[order], x[order]
    steps = np.arange(-radius, radius + 1)
    rows, columns = im.reflect(y[:, None] + steps, h), im.reflect(x[:, None] + steps, w)
    patch = gray[rows[:, :, None], columns[:, None, :]].astype(np.float64)
    angle = np.arctan2((patch * steps[None, :, None]).sum(axis=(1, 2)), (patch * steps[None, None, :]).sum(axis=(1, 2)))
    return x, y, r[y, x], angle


def binary_descriptors(gray: np.ndarray, feature: Feature, x: np.ndarray, y: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """256 comparisons of turned pairs of pixels (of 3 x 3 means of a blurred image for AKAZE): (n, 32) bytes."""
    _, radius, seed = FEATURES[feature]
    pairs = sampling_pairs(radius, seed)
    if feature == Feature.AKAZE:
        gray = im.gaussian_blur(gray[None], 0, 1.2)[0]
    h, w = gray.shape
    sin, cos = np.sin(angle)[:, None], np.cos(angle)[:, None]

    def value(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        px = x[:, None] + im.round_half_away(cos * dx - sin * dy).astype(np.int64)
        py = y[:, None] + im.round_half_away(sin * dx + cos * dy).astype(np.int64)
        if feature == Feature.ORB:
            return gray[im.reflect(py, h), im.reflect(px, w)].astype(np.float64)
        return sum(gray[im.reflect(py + a, h), im.reflect(px + b, w)].astype(np.float64) for a in (-1, 0, 1) for b in (-1, 0, 1))

    bits = value(pairs[:, 0], pairs[:, 1]) < value(pairs[:, 2], pairs[:, 3])
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1, 32)


def fnv1a(rows: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a of each row of bytes."""
    h = np.full(len(rows), 2166136261, np.uint64)
    for k in range(rows.shape[1]):
        h = ((h ^ rows[:, k].astype(np.uint64)) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return h


def word_histogram(gray: np.ndarray, feature: Feature, most: int, vocabulary: int) -> np.ndarray:
    """How many of one image's descriptors fall on each visual word."""
    x, y, _, angle = keypoints(gray, feature, most)
    if not len(x):
        return np.zeros(vocabulary)
    words = fnv1a(binary_descriptors(gray, feature, x, y, angle)) % np.uint64(vocabulary)
    return np.bincount(words.astype(np.int64), minlength=vocabulary).astype(np.float64)


#: Modulus, and below the starts and steps of the sketches' generators. Fixed values.
MINHASH_PRIME = 4294967291


@functools.lru_cache(maxsize=4)
def minhash_factors(size: int) -> tuple[tuple[int, int], ...]:
    out = []
    for i in range(size):
        s1 = mix64(0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03 & _M64)
        s2 = mix64(0x94D049BB133111EB + i * 0xBF58476D1CE4E5B9 & _M64)
        out.append((((s1 & 0xFFFFFFFF) | 1) % MINHASH_PRIME, (s2 & 0xFFFFFFFF) % MINHASH_PRIME))
    return tuple(out)


def minhash(hist: np.ndarray, size: int) -> np.ndarray:
    """The least of a * word + c modulo a prime over the words that occur, by factor pair; zeros for none."""
    words = np.flatnonzero(hist > 0).astype(np.uint64)
    if not len(words):
        return np.zeros(size)
    a, c = (np.array(v, np.uint64) for v in zip(*minhash_factors(size), strict=True))
    values = (a[:, None] * words[None, :] + c[:, None]) % np.uint64(MINHASH_PRIME)
    return np.minimum(values.min(axis=1), np.uint64(MINHASH_PRIME - 1)).astype(np.float64)


@functools.lru_cache(maxsize=4)
def simhash_signs(vocabulary: int, bits: int) -> np.ndarray:
    """(vocabulary, bits) of 1 and -1."""
    out = np.empty((vocabulary, bits))
    for word in range(vocabulary):
        base = mix64(word + 0xA0761D6478BD642F & _M64)
        out[word] = [1 if mix64(base + bit * 0xE7037ED1A0B428DB & _M64) & 1 else -1 for bit in range(bits)]
    return out


def simhash(hist: np.ndarray, bits: int) -> np.ndarray:
    return im.pack_bits((hist @ simhash_signs(len(hist), bits) > 0)[None])[0]


def visual_words(gray: np.ndarray, feature: Feature, storage: Storage, vocabulary: int, most: int, minhash_size: int, simhash_bits: int) -> np.ndarray:
    out = []
    for image in gray:
        hist = word_histogram(image, feature, most, vocabulary)
        if storage == Storage.MINHASH:
            out.append(minhash(hist, minhash_size))
        elif storage == Storage.SIMHASH:
            out.append(simhash(hist, simhash_bits))
        else:
            norm = math.sqrt((hist * hist).sum())
            out.append(hist / norm if norm else hist)
    return np.array(out)

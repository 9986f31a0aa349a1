"""Kernels against fixed values and plain loops."""

import math

import numpy as np
import pytest

from pixelsieve.kernels import descriptors as ds
from pixelsieve.kernels import imaging as im
from pixelsieve.types import Feature, Interpolation, Storage, interpolation_label

RNG = np.random.default_rng(11)
GRADIENT = ((17 * np.arange(21)[None, :] + 13 * np.arange(21)[:, None]) % 256).astype(np.uint8)
RAMP = (10 * (np.arange(10)[None, :] + np.arange(10)[:, None])).astype(np.uint8)
NOISE = RNG.integers(0, 256, (40, 37), dtype=np.uint8)
COLOUR = RNG.integers(0, 256, (3, 9, 12, 3), dtype=np.uint8)


def test_gaussian_kernel():
    assert np.allclose(im.gaussian_kernel(7, 0), [1 / 32, 7 / 64, 7 / 32, 9 / 32, 7 / 32, 7 / 64, 1 / 32])
    assert np.allclose(im.gaussian_kernel(3, 0.8), [0.23899426, 0.52201146, 0.23899426], atol=1e-7)
    assert im.gaussian_kernel(1, 0.5).tolist() == [1]
    assert im.blur_taps(0, 1.0).tolist() == [1, 13, 61, 102, 61, 13, 1]
    assert [int(im.blur_taps(0, s).sum()) for s in (1.0, 1.2, 1.6, 2.2)] == [252, 253, 251, 248]


def blur_loops(p, size, sigma):
    taps = im.blur_taps(size, sigma).tolist()
    mid = len(taps) // 2
    h, w = p.shape

    def pick(line, x, n):
        total = line[x] * taps[mid]
        for i in range(1, mid + 1):
            a = x - i if x - i >= 0 else i
            b = x + i if x + i < n else n - 1 - i
            total += line[a] * taps[mid - i] + line[b] * taps[mid + i]
        return total

    rows = [[pick([int(v) for v in p[y]], x, w) for x in range(w)] for y in range(h)]
    return np.array([[min(255, max(0, (pick([rows[k][x] for k in range(h)], y, h) + 32768) >> 16)) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("size,sigma", [(3, 0), (7, 0), (0, 1.0), (0, 1.6)])
def test_blur(size, sigma):
    assert np.array_equal(im.gaussian_blur(NOISE[None], size, sigma)[0], blur_loops(NOISE, size, sigma))


def test_reflect():
    assert im.reflect(np.array([-1, 10, 0, 9, -12, 25]), 10).tolist() == [1, 8, 0, 9, 6, 7]
    assert im.reflect(np.array([-3, 5]), 1).tolist() == [0, 0]


def test_correlate():
    kernel = RNG.normal(size=(5, 5)).astype(np.float32)
    out = im.correlate(NOISE[None], kernel)[0]
    h, w = NOISE.shape
    mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k
    for y, x in [(0, 0), (1, 36), (39, 20), (20, 20), (39, 36)]:
        want = sum(float(NOISE[mirror(y + i - 2, h), mirror(x + j - 2, w)]) * float(kernel[i, j]) for i in range(5) for j in range(5))
        assert abs(out[y, x] - want) < 1e-3


def test_transforms():
    sixteen = np.arange(1, 17).reshape(1, 4, 4)
    assert abs(im.dct2(sixteen)[0, 0, 0] - 34) < 1e-5 and im.dct2(np.full((1, 1, 1), 42))[0, 0, 0] == 42
    assert im.haar_low(sixteen, 1).ravel().tolist() == [3.5, 5.5, 11.5, 13.5] and im.haar_low(sixteen, 2).ravel().tolist() == [8.5]
    x = RNG.normal(size=(1, 8, 8))
    want = [[sum(x[0, i, j] * math.cos(math.pi * (2 * i + 1) * u / 16) * math.cos(math.pi * (2 * j + 1) * v / 16) for i in range(8) for j in range(8)) * (0.5 if u else 8**-0.5) * (0.5 if v else 8**-0.5) for v in range(8)] for u in range(8)]
    assert np.allclose(im.dct2(x)[0], want, atol=1e-5) and np.allclose(im.dct2(x, 3)[0], np.array(want)[:3, :3], atol=1e-5)


def test_statistics():
    of = lambda *v: np.array([v], np.uint8)[None]
    assert im.gray_mean(of(0, 100, 100, 200))[0] == 100 and im.gray_median(of(10, 30, 20))[0] == 20
    assert im.gray_median(of(1, 2, 30, 40))[0] == (2 + 40) / 2
    assert im.median32(np.array([[4, 1, 3, 2]], np.float32))[0] == 2.5
    assert im.round_half_away(np.array([-0.5, 1.5, 127.5, -1.4])).tolist() == [-1, 2, 128, -1]


def test_equalize():
    p = (16 * np.arange(4)[None, :] + 4 * np.arange(4)[:, None]).astype(np.uint8)[None]
    out = im.equalize(p)[0]
    assert out[0, 0] == 0 and out.max() == 255 and (np.argsort(out.ravel(), kind="stable") == np.argsort(p.ravel(), kind="stable")).all()
    assert not im.equalize(np.full((1, 3, 3), 7, np.uint8)).any()
    near = np.full((1, 3, 3), 100, np.uint8)
    near[0, 1, 1] = 50
    assert sorted(set(im.equalize(near).ravel().tolist())) == [0, 255]


def test_resampling():
    for i in Interpolation:
        for a, b in ((8, 8), (8, 5), (5, 8), (100, 7), (1, 4)):
            w = im.resampling_weights(a, b, i)
            assert np.allclose(w.sum(axis=1), 1) and w.shape == (b, a)
    assert np.array_equal(im.resampling_weights(8, 4, Interpolation.BILINEAR)[1], np.array([0, 0.125, 0.375, 0.375, 0.125, 0, 0, 0]))
    lanczos2, mitchell = im.KERNELS[Interpolation.LANCZOS2][1], im.KERNELS[Interpolation.MITCHELL_NETRAVALI][1]
    assert lanczos2(0) == 1 and lanczos2(2) == 0 and mitchell(3) == 0 and abs(mitchell(0) - 16 / 18) < 1e-12
    for i in Interpolation:
        assert np.array_equal(im.resize(np.full((1, 9, 7), 200, np.uint8), 4, 5, i), np.full((1, 5, 4), 200))
        grey = np.repeat(NOISE[None, ..., None], 3, axis=-1)
        assert np.array_equal(im.resize(grey, 16, 16, i)[..., 1], im.resize(NOISE[None], 16, 16, i))
        assert np.array_equal(im.resize(NOISE[None], 37, 40, i)[0], NOISE) or i == Interpolation.MITCHELL_NETRAVALI
    assert np.array_equal(im.resize(RAMP[None], 5, 5, Interpolation.NEAREST)[0], RAMP[1::2, 1::2])
    assert [interpolation_label(k) for k in (0, 3, 6, 99, -1)] == ["Nearest", "MitchellNetravali", "BilinearExact", "Unknown", "Unknown"]


def test_colour():
    for r, g, b in [(255, 0, 0), (0, 255, 0), (0, 0, 255), (10, 200, 30), (0, 0, 0), (255, 255, 255), (17, 17, 18)]:
        p = np.array([r, g, b], np.uint8).reshape(1, 1, 1, 3)
        assert abs(int(im.to_gray(p).item()) - (0.299 * r + 0.587 * g + 0.114 * b)) <= 1
        y, cr, cb = im.ycrcb(p).ravel().tolist()
        assert abs(y - (0.299 * r + 0.587 * g + 0.114 * b)) <= 1 and abs(cr - min(255, 128 + 0.713 * (r - y))) <= 1.5 and abs(cb - min(255, 128 + 0.564 * (b - y))) <= 1.5
        h, s, v = im.hsv(p).ravel().tolist()
        low, high = min(r, g, b), max(r, g, b)
        assert v == high and abs(s - (255 * (high - low) / high if high else 0)) <= 0.51 and 0 <= h < 180
    assert [im.hsv(np.array(c, np.uint8).reshape(1, 1, 1, 3)).ravel()[0] for c in ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 255))] == [0, 60, 120, 150]
    assert im.jfif(np.array([255, 0, 0], np.uint8).reshape(1, 1, 1, 3)).ravel().tolist() == [76, 85, 255]


def jarosz_loops(p, half, times):
    x = [[np.float32(v) for v in row] for row in p]

    def line(v):
        w, s = np.float32(2 * half + 1), v[0] * np.float32(half)
        for j in range(1, min(half, len(v) - 1) + 1):
            s = s + v[j]
        s = s + v[0]
        v[0] = s / w
        for j in range(1, len(v)):
            lead = v[j + half] if j + half < len(v) else np.float32(0)
            trail = v[j - half - 1] if j - half - 1 >= 0 else np.float32(0)
            s = s + (lead - trail)
            v[j] = s / w

    for _ in range(times):
        for row in x:
            line(row)
    columns = [list(c) for c in zip(*x)]
    for _ in range(times):
        for c in columns:
            line(c)
    return np.array(columns, np.float32).T


def test_jarosz():
    assert np.array_equal(im.jarosz(NOISE[None], 2, 2)[0], jarosz_loops(NOISE, 2, 2))


def test_moments():
    p = (10 * np.arange(4)[None, :] + 5 * np.arange(4)[:, None] + 50).astype(float)[None]
    m = im.raw_moments(p)
    for i in range(4):
        for j in range(4 - i):
            assert m[f"m{i}{j}"][0] == sum(p[0, y, x] * x**i * y**j for y in range(4) for x in range(4))
    assert not im.hu_moments(np.zeros((1, 3, 3))).any()
    big = np.zeros((1, 64, 64))
    big[0, 10:30, 20:50] = NOISE[:20, :30]
    assert np.allclose(im.hu_moments(big)[0, :6], im.hu_moments(np.rot90(big, axes=(1, 2)))[0, :6], rtol=1e-6, atol=1e-18)
    assert np.allclose(im.hu_moments(big), im.hu_moments(np.roll(big, (7, -9), axis=(1, 2))), rtol=1e-6, atol=1e-18)


def test_bits():
    assert im.pack_bits(np.array([[1] + [0] * 7 + [1]])).tolist() == [[1, 1]] and im.pack_bits(np.array([[1] + [0] * 7 + [1]]), False).tolist() == [[128, 128]]
    assert ds.mean_bits(np.array([[[0, 100], [100, 200]]], np.uint8)).tolist() == [[8]]
    assert ds.rising_bits(np.array([[[1, 2, 2], [5, 4, 9]]], np.uint8)).tolist() == [[0b1001]]


def test_blocks():
    p = NOISE[None, :40, :36]
    means = ds.block_means(p, 6, 8, True)[0]
    want = [p[0, y : y + 8, x : x + 6].mean() for y in range(0, 33, 4) for x in range(0, 31, 3)]
    assert np.allclose(means, want)
    turned = ds.block_bits(p, 6, 8, False, 24)
    plain = ds.block_bits(p, 6, 8, False)
    bits = lambda x: np.unpackbits(x, bitorder="little")
    assert np.array_equal(bits(turned[0])[:30], bits(plain[0])[:30]) and turned.shape[1] == 90
    assert np.array_equal(ds.rotate(GRADIENT[None], 90)[0], np.rot90(GRADIENT)) or np.array_equal(ds.rotate(GRADIENT[None], 90)[0], np.rot90(GRADIENT, -1))
    assert np.array_equal(ds.rotate(GRADIENT[None], 180)[0], GRADIENT[::-1, ::-1])


def test_marr_hildreth():
    kernel = ds.marr_hildreth_kernel(1.0, 2.0)
    assert kernel.shape == (17, 17) and kernel[8, 8] == 2
    p = RNG.integers(0, 256, (1, 512, 512), dtype=np.uint8)
    f = im.correlate(p, kernel)[0, :496, :496].astype(np.float64)
    blocks = f.reshape(31, 16, 31, 16).sum(axis=(1, 3))
    bits = []
    for r in range(0, 29, 4):
        for c in range(0, 29, 4):
            part = blocks[c : c + 3, r : r + 3].T.ravel()
            bits += (part > part.mean()).tolist()
    assert (np.packbits(bits) != ds.marr_hildreth_bits(p, 1.0, 2.0)[0]).sum() <= 1
    assert ds.marr_hildreth_bits(p, 1.0, 2.0).shape == (1, 72)


def test_rings():
    p = NOISE[None, :32, :30]
    got = ds.ring_means(p, 5)[0]
    found = [[] for _ in range(5)]
    for y in range(32):
        for x in range(30):
            found[min(4, int(math.hypot(x + 0.5 - 15, y + 0.5 - 16) / 3))].append(int(p[0, y, x]))
    assert np.allclose(got, [np.mean(v) for v in found])
    assert ds.ring_bits(p, 1).shape == (1, 0) and ds.ring_bits(p, 5).shape == (1, 1) and ds.ring_bits(p, 180).shape == (1, 8)


def rays_loops(p, angles):
    """Lines of samples by the slopes' definition."""
    h, w = p.shape
    side = max(h, w)
    lines, counts = np.zeros((angles, side)), np.zeros(angles)

    def down(k, x):
        t = np.float32(math.tan(float(np.float32(k) * np.float32(math.pi) / np.float32(angles)))) * np.float32(x - w // 2)
        return math.floor(float(t + np.float32(0.5 if t >= 0 else -0.5)))

    for k in list(range(angles // 4 + 1)) + list(range(3 * angles // 4, angles)):
        for x in range(side):
            y = down(k, x)
            if 0 <= y + h // 2 < h and x < w:
                lines[k, x] = p[y + h // 2, x]
                counts[k] += 1
            if k < angles // 4 and 0 <= y + w // 2 < w and x < h:
                lines[angles // 2 - k, x] = p[x, y + w // 2]
                counts[angles // 2 - k] += 1
            if k > 3 * angles // 4 and 0 <= h // 2 - y < w and 0 <= 2 * (h // 2) - x < h:
                at = k - 2 * (k - 3 * angles // 4)
                lines[at, x] = p[2 * (h // 2) - x, h // 2 - y]
                counts[at] += 1
    n = counts[:, None] + 1e-5
    f = (lines**2 / n).sum(axis=1) - ((lines / n).sum(axis=1)) ** 2
    return (f - f.mean()) / math.sqrt((f * f).mean() - f.mean() ** 2)


def test_radial():
    for p in (NOISE, NOISE[:, :20], NOISE[:17]):
        assert np.allclose(ds.radial_features(p[None], 60)[0], rays_loops(p.astype(float), 60), atol=1e-7)
    out = ds.radial_bytes(NOISE[None], 180)
    assert out.shape == (1, 40) and out.max() == 255
    assert not ds.radial_bytes(np.zeros((1, 9, 9), np.uint8), 180).any()


def test_layout_and_edges():
    flat = np.full((1, 64, 64, 3), 128, np.uint8)
    assert ds.layout_bytes(flat)[0].tolist() == [32, 16, 16, 16, 16, 16, 32, 16, 16, 32, 16, 16]
    assert ds.layout_bytes(COLOUR).shape == (3, 12) and ds.layout_bytes(NOISE[None]).shape == (1, 12)
    stripes = np.tile(np.array([0, 255], np.uint8), (32, 16))[None]
    assert (ds.edge_shares(stripes)[0].argmax(axis=1) == 0).all() and ds.edge_bytes(stripes)[0, ::5].tolist() == [7] * 16
    assert (ds.edge_shares(np.swapaxes(stripes, 1, 2))[0].argmax(axis=1) == 1).all()
    assert not ds.edge_shares(np.full((1, 3, 3), 9, np.uint8)).any() and ds.edge_bytes(NOISE[None]).shape == (1, 80)


def test_lbp():
    p = NOISE[:9, :7]
    want = np.zeros(p.shape, int)
    for y in range(9):
        for x in range(7):
            for k, (dx, dy) in enumerate(ds.LBP_NEIGHBOURS):
                if 0 <= x + dx < 7 and 0 <= y + dy < 9 and p[y + dy, x + dx] >= p[y, x]:
                    want[y, x] |= 1 << k
    assert np.array_equal(ds.lbp_codes(p[None])[0], want)
    out = ds.lbp_bytes(NOISE[None], 2, 2)
    assert out.shape == (1, 1024) and all(out[0].reshape(4, 256).max(axis=1) == 255)


def test_gradients():
    out = ds.gradient_bytes(np.tile(np.arange(0, 160, 10, dtype=np.uint8), (16, 1))[None], 8, 9)
    assert out.shape == (1, 36) and out[0, ::9].tolist() == [255] * 4 and out.sum() == 4 * 255
    m, a = ds.gradients(NOISE[None])
    assert m[0, 5, 5] == math.hypot(int(NOISE[5, 6]) - int(NOISE[5, 4]), int(NOISE[6, 5]) - int(NOISE[4, 5])) and (a >= 0).all() and (a < 180).all()
    assert ds.gradient_bytes(NOISE[None], 64, 9).shape == (1, 9)


def test_zernike():
    p = np.zeros((1, 64, 64), np.uint8)
    p[0, 12:52, 14:51] = NOISE
    got = ds.zernike_magnitudes(p, 8)
    assert got.shape == (1, 24) and ds.zernike_magnitudes(p, 4).shape == (1, 8)
    assert np.allclose(got, ds.zernike_magnitudes(np.ascontiguousarray(np.rot90(p, axes=(1, 2))), 8), atol=1e-9)
    assert not ds.zernike_magnitudes(np.zeros((1, 9, 9), np.uint8), 8).any()
    total, mass = 0, 0
    for y in range(64):
        for x in range(64):
            u, v = (x - 31.5) / 32, (y - 31.5) / 32
            if u * u + v * v <= 1:
                total += p[0, y, x] / 255 * math.hypot(u, v) * np.exp(-1j * math.atan2(v, u))
                mass += p[0, y, x] / 255
    assert abs(got[0, 0] - abs(total) * 2 / mass) < 1e-9


def test_gist():
    p = RNG.integers(0, 256, (1, 20, 24), dtype=np.uint8)
    got = ds.gist(p, 2, 2)
    assert got.shape == (1, 80) and abs(np.linalg.norm(got) - 1) < 1e-12
    x = p[0] / 255.0
    x = (x - x.mean()) / x.std()
    f = ds.gabor_bank()[1][3]
    reach = f.shape[0] // 2
    mirror = lambda k, n: int(im.reflect(np.array([k]), n)[0])
    cells = np.zeros(4)
    for r in range(20):
        for c in range(24):
            s = sum(x[mirror(r + i, 20), mirror(c + j, 24)] * f[i + reach, j + reach] for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))
            cells[r * 2 // 20 * 2 + c * 2 // 24] += abs(s) / 120
    part = got[0][(8 + 3) * 4 : (8 + 3) * 4 + 4]
    assert np.allclose(part / part.sum(), cells / cells.sum(), atol=1e-9)
    assert not ds.gist(np.full((1, 8, 8), 3, np.uint8), 2, 2).any()


def test_features():
    p = RNG.integers(0, 256, (48, 52), dtype=np.uint8)
    fast = ds.fast_responses(p)
    for y in range(48):
        for x in range(52):
            want = 0
            if 3 <= y < 45 and 3 <= x < 49:
                ring = [int(p[y + dy, x + dx]) for dx, dy in ds.FAST_CIRCLE]
                c = int(p[y, x])
                runs = lambda f: any(all(f(ring[(k + i) % 16]) for i in range(9)) for k in range(16))
                if runs(lambda v, c=c: v >= c + 20) or runs(lambda v, c=c: v <= c - 20):
                    want = sum(abs(v - c) for v in ring)
            assert fast[y, x] == want
    for feature in Feature:
        x, y, r, a = ds.keypoints(p, feature, 7)
        assert len(x) <= 7 and (np.diff(r) <= 0).all() and (np.abs(a) <= math.pi).all()
        d = ds.binary_descriptors(p, feature, x, y, a)
        assert d.shape == (len(x), 32)
    x, y, r, a = ds.keypoints(p, Feature.ORB, 1)
    if len(x):
        window = lambda k, n: [int(im.reflect(np.array([v]), n)[0]) for v in range(k - 8, k + 9)]
        rows, columns = window(int(y[0]), 48), window(int(x[0]), 52)
        m10 = sum((j - 8) * float(p[rr, cc]) for rr in rows for j, cc in enumerate(columns))
        m01 = sum((i - 8) * float(p[rr, cc]) for i, rr in enumerate(rows) for cc in columns)
        assert abs(a[0] - math.atan2(m01, m10)) < 1e-9
    assert not ds.fast_responses(np.zeros((6, 6), np.uint8)).any() and len(ds.keypoints(np.zeros((30, 30), np.uint8), Feature.AKAZE, 5)[0]) == 0


def test_sketches():
    assert ds.fnv1a(np.frombuffer(b"foobar", np.uint8)[None]).tolist() == [0xBF9CF968]
    hist = np.array([0, 3, 0, 1.0])
    a, c = ds.minhash_factors(5)[4]
    assert ds.minhash(hist, 5)[4] == min((a * w + c) % ds.MINHASH_PRIME for w in (1, 3)) and not ds.minhash(hist * 0, 5).any()
    signs = ds.simhash_signs(4, 12)
    votes = [3 * signs[1, k] + signs[3, k] for k in range(12)]
    assert np.unpackbits(ds.simhash(hist, 12), bitorder="little")[:12].tolist() == [int(v > 0) for v in votes]
    p = RNG.integers(0, 256, (2, 64, 64), dtype=np.uint8)
    assert ds.visual_words(p, Feature.ORB, Storage.HISTOGRAM, 256, 500, 64, 128).shape == (2, 256)
    assert ds.visual_words(p, Feature.AKAZE, Storage.MINHASH, 256, 500, 64, 128).shape == (2, 64)
    assert ds.visual_words(p, Feature.ORB, Storage.SIMHASH, 256, 500, 64, 100).shape == (2, 13)
    assert ds.mix64(0) == 0xE220A8397B1DCDAF

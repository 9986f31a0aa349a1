"""SQL (DuckDB) of hashers over images: pixels are rows, and what depends on places alone is a table of weights."""

from __future__ import annotations

import math

import numpy as np

from pixelsieve.kernels import descriptors as ds
from pixelsieve.kernels import imaging as im
from pixelsieve.plans.sql import R8, entries, numbers, table
from pixelsieve.types import Feature, Interpolation

_AT = "p[CAST(k + 1 AS INTEGER)]"
#: Pixels of the queries' gray and colour images of 8 x 8.
GRAY = f"{R8}, px AS (SELECT vec_id, (k // 8)::INTEGER AS y, (k % 8)::INTEGER AS x, {_AT}::BIGINT AS v FROM r, range(64) t(k))"
COLOUR = f"{R8}, px AS (SELECT vec_id, (k // 8)::INTEGER AS y, (k % 8)::INTEGER AS x, {_AT}::BIGINT AS r, p[CAST(64 - k AS INTEGER)]::BIGINT AS g, (255 - {_AT})::BIGINT AS b FROM r, range(64) t(k))"
RGB = ("r", "g", "b")


def luma(source: str) -> str:
    """Named gr: the gray pixels of a table of colours."""
    return f"gr AS (SELECT vec_id, y, x, (19595 * r * 257 + 38470 * g * 257 + 7471 * b * 257 + 32768) >> 24 AS v FROM {source})"


def along(name: str, source: str, axis: str, matrix: np.ndarray, columns=("v",)) -> str:
    """A table whose pixels are weighted sums of a line: `matrix` has a row for each new place."""
    other = "x" if axis == "y" else "y"
    sums = ", ".join(f"sum({c} * w) AS {c}" for c in columns)
    return f"{name} AS (SELECT vec_id, {other}, t.place AS {axis}, {sums} FROM {source} JOIN {table(entries(matrix), 't(place, f, w)')} ON {source}.{axis} = t.f GROUP BY vec_id, {other}, t.place)"


def _one_axis(name: str, source: str, axis: str, matrix: np.ndarray, columns) -> str:
    """As along(), term by term in the order of places, from lists of the lines' pixels."""
    other = "x" if axis == "y" else "y"
    rows, most = [], max(int(np.count_nonzero(line)) for line in matrix)
    for place, line in enumerate(matrix):
        f = np.flatnonzero(line)
        f = np.concatenate((f, np.full(most - len(f), f[-1])))
        rows.append((place, *f.tolist(), *line[f][: np.count_nonzero(line)], *[0.0] * (most - np.count_nonzero(line))))
    taps = table(rows, f"t(place, {', '.join(f'f{k}' for k in range(most))}, {', '.join(f'w{k}' for k in range(most))})")
    sums = ", ".join(" + ".join(f"l.{c}[f{k} + 1] * w{k}" for k in range(most)) + f" AS {c}" for c in columns)
    lists = ", ".join(f"list({c} ORDER BY {axis}) AS {c}" for c in columns)
    return f"{name}_l AS (SELECT vec_id, {other}, {lists} FROM {source} GROUP BY vec_id, {other}), {name} AS (SELECT vec_id, {other}, t.place AS {axis}, {sums} FROM {name}_l l, {taps})"


def resized(name: str, source: str, width: int, height: int, interpolation: Interpolation, columns=("v",), size: int = 8) -> str:
    """Separable resampling, rounded to 16 bits and cut to 8."""
    cut = ", ".join(f"greatest(0, least(65535, floor({c} * 257 + 0.5)))::BIGINT >> 8 AS {c}" for c in columns)
    return ", ".join((
        _one_axis(f"{name}_a", source, "x", im.resampling_weights(size, width, interpolation), columns),
        _one_axis(f"{name}_b", f"{name}_a", "y", im.resampling_weights(size, height, interpolation), columns),
        f"{name} AS (SELECT vec_id, y, x, {cut} FROM {name}_b)",
    ))


def blurred(name: str, source: str, size: int, taps: np.ndarray, columns=("v",)) -> str:
    matrix = im._one_axis(np.eye(size, dtype=np.int64), taps, 1).T
    cut = ", ".join(f"greatest(0, least(255, ({c} + 32768)::BIGINT >> 16)) AS {c}" for c in columns)
    return ", ".join((_one_axis(f"{name}_a", source, "x", matrix, columns), _one_axis(f"{name}_b", f"{name}_a", "y", matrix, columns), f"{name} AS (SELECT vec_id, y, x, {cut} FROM {name}_b)"))


def packed(ctes: str, bits: str) -> str:
    """Bytes of a table of bits: vec_id, k, bit."""
    return (
        f"WITH {ctes}, out_bits AS ({bits}), out_bytes AS (SELECT vec_id, k // 8 AS place, sum(CASE WHEN bit THEN 1 << (k % 8)::INTEGER ELSE 0 END)::INTEGER AS byte FROM out_bits GROUP BY ALL) "
        "SELECT vec_id, list(byte ORDER BY place) AS hash FROM out_bytes GROUP BY vec_id"
    )


def average() -> str:
    return packed(f"{COLOUR}, {luma('px')}, m AS (SELECT vec_id, round(avg(v)) AS m FROM gr GROUP BY vec_id)", "SELECT vec_id, y * 8 + x AS k, v > m AS bit FROM gr JOIN m USING (vec_id)")


def median() -> str:
    m = "s AS (SELECT vec_id, list(v ORDER BY v) AS s FROM gr GROUP BY vec_id), m AS (SELECT vec_id, round((s[32] + s[34]) / 2.0) AS m FROM s)"
    return packed(f"{COLOUR}, {luma('px')}, {m}", "SELECT vec_id, y * 8 + x AS k, v > m AS bit FROM gr JOIN m USING (vec_id)")


def difference() -> str:
    rises = "SELECT vec_id, y * 8 + x AS k, after > v AS bit FROM (SELECT *, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS after FROM gr) WHERE x < 8"
    return packed(f"{COLOUR}, {resized('rz', 'px', 9, 8, Interpolation.BILINEAR, RGB)}, {luma('rz')}", rises)


def dct(source: str, size: int, keep: int) -> str:
    """Named c: the low frequencies in single precision, k in row-major order."""
    basis = im.dct_matrix(size)[:keep]
    return f"{along('d_a', source, 'x', basis)}, {along('d_b', 'd_a', 'y', basis)}, c AS (SELECT vec_id, y * {keep} + x AS k, v::FLOAT AS v FROM d_b)"


def phash() -> str:
    low = "l AS (SELECT vec_id, k, CASE WHEN k = 0 THEN 0::FLOAT ELSE v END AS v FROM c), m AS (SELECT vec_id, avg(v::DOUBLE) AS m FROM l GROUP BY vec_id)"
    return packed(f"{COLOUR}, {resized('rz', 'px', 32, 32, Interpolation.BILINEAR_EXACT, RGB)}, {luma('rz')}, {dct('gr', 32, 8)}, {low}", "SELECT vec_id, k, v > m AS bit FROM l JOIN m USING (vec_id)")


def wavelet() -> str:
    low = "l AS (SELECT vec_id, (y // 8) * 8 + x // 8 AS k, avg(v) AS v FROM gr GROUP BY ALL), m AS (SELECT vec_id, median(v) AS m FROM l GROUP BY vec_id)"
    return packed(f"{COLOUR}, {resized('rz', 'px', 64, 64, Interpolation.BILINEAR, RGB)}, {luma('rz')}, {low}", "SELECT vec_id, k, v > m AS bit FROM l JOIN m USING (vec_id)")


def block_mean() -> str:
    blocks = "s AS (SELECT vec_id, (y // 16) * 16 + x // 16 AS k, sum(v) AS s FROM gr GROUP BY ALL), m AS (SELECT vec_id, sum(s) AS m FROM s GROUP BY vec_id)"
    return packed(f"{COLOUR}, {resized('rz', 'px', 256, 256, Interpolation.BILINEAR_EXACT, RGB)}, {luma('rz')}, {blocks}", "SELECT vec_id, k, s * 256 >= m AS bit FROM s JOIN m USING (vec_id)")


def turned(overlap: bool) -> str:
    """Blocks of 16 of an image of 64 x 64 in 24 directions, from sums of 8 x 8 pixels."""
    places = (
        "z AS (SELECT d, y, x, cos(d * 15 * pi() / 180) * (x - 31.5) + sin(d * 15 * pi() / 180) * (y - 31.5) + 31.5 AS fx, -sin(d * 15 * pi() / 180) * (x - 31.5) + cos(d * 15 * pi() / 180) * (y - 31.5) + 31.5 AS fy "
        "FROM range(24) a(d), range(64) b(y), range(64) c(x)), "
        "n AS (SELECT d, y // 8 AS y8, x // 8 AS x8, round(fx)::INTEGER AS px, round(fy)::INTEGER AS py FROM z WHERE round(fx) BETWEEN 0 AND 63 AND round(fy) BETWEEN 0 AND 63), "
        "h AS (SELECT d, y8, x8, py, px, count(*) AS times FROM n GROUP BY ALL), "
        "q AS (SELECT vec_id, d, y8, x8, sum(v * times) AS s FROM rz JOIN h ON rz.y = h.py AND rz.x = h.px GROUP BY ALL), "
        "m AS (SELECT vec_id, d, sum(s) AS m FROM q GROUP BY ALL)"
    )
    side, step = (7, 1) if overlap else (4, 2)
    grid = f"g AS (SELECT y, x, y * {step} + dy AS y8, x * {step} + dx AS x8 FROM range({side}) a(y), range({side}) b(x), range(2) e(dy), range(2) f(dx))"
    sums = f"s AS (SELECT i.vec_id, i.d, g.y, g.x, coalesce(sum(q.s), 0) AS s FROM m i CROSS JOIN g LEFT JOIN q ON q.vec_id = i.vec_id AND q.d = i.d AND q.y8 = g.y8 AND q.x8 = g.x8 GROUP BY ALL)"
    return packed(f"{GRAY}, {resized('rz', 'px', 64, 64, Interpolation.BILINEAR_EXACT)}, {places}, {grid}, {sums}", f"SELECT vec_id, d * {side * side} + y * {side} + x AS k, s * 16 >= m AS bit FROM s JOIN m USING (vec_id, d)")


def radial(angles: int = 180, size: int = 40) -> str:
    """The hash before it is cut to bytes: where a coefficient is the largest, a byte hangs on a last digit."""
    slot, pixel, count = ds._rays(8, 8, angles)
    rays = table([(int(s) // 8, int(p) // 8, int(p) % 8, count[int(s) // 8] + 1e-5) for s, p in zip(slot, pixel, strict=True)], "t(line, row, col, n)")
    return (
        f"WITH {GRAY}, {blurred('u', 'px', 8, im.blur_taps(0, 1.0))}, "
        f"l AS (SELECT vec_id, line, sum(v * v) / max(n) - (sum(v) / max(n)) ** 2 AS f FROM u JOIN {rays} ON u.y = t.row AND u.x = t.col GROUP BY ALL), "
        f"a AS (SELECT vec_id, line, coalesce(f, 0) AS f FROM (SELECT DISTINCT vec_id FROM l) CROSS JOIN range({angles}) g(line) LEFT JOIN l USING (vec_id, line)), "
        "m AS (SELECT vec_id, avg(f) AS m, sqrt(avg(f * f) - avg(f) ** 2) AS s FROM a GROUP BY vec_id), "
        f"c AS (SELECT vec_id, k, sum((f - m) / s * cos(pi() * (2 * line + 1) * k / {2 * angles}) * CASE WHEN k = 0 THEN 1 ELSE sqrt(2) END / sqrt({angles})) AS c FROM a JOIN m USING (vec_id), range({size}) t(k) GROUP BY ALL), "
        "e AS (SELECT vec_id, greatest(0, max(c)) AS high, least(0, min(c)) AS low FROM c GROUP BY vec_id) "
        "SELECT vec_id, list(round(255 * (c - low) / (high - low), 6) + 0e0 ORDER BY k) AS hash FROM c JOIN e USING (vec_id) GROUP BY vec_id"
    )


def log_filter() -> str:
    kernel = ds.marr_hildreth_kernel(1.0, 1.0).astype(np.float64)
    reach = len(kernel) // 2
    weights = np.zeros((64, 64))
    for to in range(64):
        for i, row in enumerate(kernel):
            for j, w in enumerate(row):
                y, x = im.reflect(np.array([to // 8 + i - reach, to % 8 + j - reach]), 8)
                weights[to, y * 8 + x] += w
    sums = f"list_transform([{', '.join(map(numbers, weights))}], lambda w: list_sum(list_transform(range(64), lambda k: {_AT} * w[CAST(k + 1 AS INTEGER)])))"
    return f"WITH {R8} SELECT vec_id, list_transform({sums}, lambda v: round(v::FLOAT::DOUBLE, 3) + 0e0) AS pixels FROM r"


def boxes(name: str, source: str, size: int, half: int, times: int) -> str:
    """Running means over lines of a table (vec_id, line, v: a list), step by step in single precision. A step has
    the running sum and the means so far in one list."""
    out, last, width = [], source, f"{2 * half + 1}::FLOAT"
    for k in range(times):
        start = " + ".join([f"v[1] * {half}::FLOAT", *[f"v[{j + 1}]" for j in range(1, half + 1)], "v[1]"])
        lead, trail = f"coalesce(v[(j[1] + {half + 1})::INTEGER], 0::FLOAT)", f"CASE WHEN j[1] > {half} THEN acc[(j[1] - {half} + 1)::INTEGER] ELSE 0::FLOAT END"
        now = f"(acc[1] + ({lead} - {trail})::FLOAT)::FLOAT"
        step = f"[{now}] || acc[2:] || [({now} / {width})::FLOAT]"
        every = f"list_reduce(list_transform(range(1, {size}), lambda j: [j::FLOAT]), lambda acc, j: {step}, [({start})::FLOAT, (({start})::FLOAT / {width})::FLOAT])"
        out.append(f"{name}_{k} AS (SELECT vec_id, line, ({every})[2:] AS v FROM {last})")
        last = f"{name}_{k}"
    return ", ".join(out)


def jarosz(source: str, size: int, half: int = 2, times: int = 2) -> str:
    """Named jz (vec_id, y, x, v): box means along rows, then columns."""
    lists = f"ja AS (SELECT vec_id, y AS line, list(v::FLOAT ORDER BY x) AS v FROM {source} GROUP BY vec_id, y)"
    last = times - 1
    turn = f"jb AS (SELECT vec_id, x AS line, list(e ORDER BY line) AS v FROM (SELECT vec_id, line, (t.x)::INTEGER AS x, v[(t.x + 1)::INTEGER] AS e FROM jr_{last}, range({size}) t(x)) GROUP BY vec_id, x)"
    back = f"jz AS (SELECT vec_id, (t.y)::INTEGER AS y, line AS x, v[(t.y + 1)::INTEGER] AS v FROM jc_{last}, range({size}) t(y))"
    return f"{lists}, {boxes('jr', 'ja', size, half, times)}, {turn}, {boxes('jc', 'jb', size, half, times)}, {back}"


def jarosz_query() -> str:
    return f"WITH {GRAY}, {jarosz('px', 8)} SELECT vec_id, list(round(v::DOUBLE, 3) + 0e0 ORDER BY y, x) AS pixels FROM jz GROUP BY vec_id"


def pdq() -> str:
    m = "s AS (SELECT vec_id, list(v ORDER BY v) AS s FROM c GROUP BY vec_id), m AS (SELECT vec_id, (s[128] + s[129])::FLOAT / 2::FLOAT AS m FROM s)"
    return packed(f"{GRAY}, {resized('rz', 'px', 64, 64, Interpolation.BILINEAR)}, {jarosz('rz', 64)}, {dct('jz', 64, 16)}, {m}", "SELECT vec_id, k, v > m AS bit FROM c JOIN m USING (vec_id)")


def layout() -> str:
    byte = lambda v: f"greatest(0, least(255, ({v})::BIGINT >> 16))"
    planes = (byte("19595 * r + 38470 * g + 7471 * b + 32768"), byte("-11056 * r - 21712 * g + 32768 * b + 8421376"), byte("32768 * r - 27440 * g - 5328 * b + 8421376"))
    means = f"q AS (SELECT vec_id, y // 8 AS cy, x // 8 AS cx, {', '.join(f'avg({p}) AS v{n}' for n, p in enumerate(planes))} FROM rz GROUP BY ALL)"
    lists = f"l AS (SELECT vec_id, {', '.join(f'list(v{n} ORDER BY cy, cx) AS l{n}' for n in range(3))} FROM q GROUP BY vec_id)"
    c, parts, coefficients = im.dct_matrix(8), [], []
    for n, keep in enumerate(ds.CLD_COEFFICIENTS):
        basis = "[" + ", ".join(numbers([c[z // 8][y] * c[z % 8][x] for y in range(8) for x in range(8)]) for z in ds.ZIGZAG[:keep]) + "]"
        coefficients.append(f"list_transform({basis}, lambda w: list_sum(list_transform(range(64), lambda k: l{n}[CAST(k + 1 AS INTEGER)] * w[CAST(k + 1 AS INTEGER)]))) AS c{n}")
        parts.append(f"[greatest(0, least(63, round(c{n}[1]::FLOAT::DOUBLE / 8 * 63 / 255)))::INTEGER] || list_transform(c{n}[2:], lambda v: greatest(0, least(31, round(v::FLOAT::DOUBLE / 16) + 16))::INTEGER)")
    return f"WITH {COLOUR}, {resized('rz', 'px', 64, 64, Interpolation.BILINEAR, RGB)}, {means}, {lists}, e AS (SELECT vec_id, {', '.join(coefficients)} FROM l) SELECT vec_id, {' || '.join(parts)} AS hash FROM e"


def edges() -> str:
    corner = lambda dy, dx: f"sum(CASE WHEN y % 2 = {dy} AND x % 2 = {dx} THEN v ELSE 0 END)"
    levels = "[" + ", ".join(numbers(row) for row in ds.EDGE_CENTROIDS) + "]"
    return (
        f"WITH {GRAY}, {resized('rz', 'px', 256, 256, Interpolation.BILINEAR)}, "
        f"q AS (SELECT vec_id, y // 2 AS y2, x // 2 AS x2, {corner(0, 0)} AS a, {corner(0, 1)} AS b, {corner(1, 0)} AS c, {corner(1, 1)} AS d FROM rz GROUP BY vec_id, y // 2, x // 2), "
        "e AS (SELECT vec_id, (y2 // 32) * 4 + x2 // 32 AS cell, [abs(a - b + c - d)::DOUBLE, abs(a + b - c - d)::DOUBLE, abs(sqrt(2) * (a - d)), abs(sqrt(2) * (b - c)), abs(2 * (a - b - c + d))::DOUBLE] AS s FROM q), "
        f"t AS (SELECT vec_id, cell, CASE WHEN list_max(s) >= {ds.EDGE_THRESHOLD} THEN list_position(s, list_max(s)) ELSE 0 END AS kind FROM e), "
        "h AS (SELECT vec_id, cell, g.kind AS kind, sum(CASE WHEN t.kind = g.kind THEN 1 ELSE 0 END) / 1024.0::DOUBLE AS share FROM t, range(1, 6) g(kind) GROUP BY vec_id, cell, g.kind), "
        f"f AS (SELECT vec_id, cell, kind, list_transform({levels}[kind::INTEGER], lambda c: abs(share - c)) AS far FROM h) "
        "SELECT vec_id, list((list_position(far, list_min(far)) - 1)::INTEGER ORDER BY cell, kind) AS hash FROM f GROUP BY vec_id"
    )


def binary_patterns() -> str:
    row = {-1: "up", 0: "c", 1: "dn"}
    code = " + ".join(f"CASE WHEN coalesce({row[dy]}[t.x + 1 + {dx}], -1) >= c[t.x + 1] THEN {1 << k} ELSE 0 END" for k, (dx, dy) in enumerate(ds.LBP_NEIGHBOURS))
    return (
        f"WITH {GRAY}, {resized('rz', 'px', 256, 256, Interpolation.BILINEAR)}, l AS (SELECT vec_id, y, list(v ORDER BY x) AS c FROM rz GROUP BY vec_id, y), "
        "n AS (SELECT a.vec_id, a.c, b.c AS up, d.c AS dn FROM l a LEFT JOIN l b ON b.vec_id = a.vec_id AND b.y = a.y - 1 LEFT JOIN l d ON d.vec_id = a.vec_id AND d.y = a.y + 1), "
        f"h AS (SELECT vec_id, {code} AS code, count(*) AS n FROM n, range(256) t(x) GROUP BY ALL), m AS (SELECT vec_id, max(n) AS top FROM h GROUP BY vec_id) "
        "SELECT vec_id, list(floor(coalesce(n, 0) * 255.0::DOUBLE / top)::INTEGER ORDER BY code) AS hash FROM m CROSS JOIN range(256) g(code) LEFT JOIN h USING (vec_id, code) GROUP BY vec_id"
    )


def rings(count: int = 180, keep: int = 64) -> str:
    ring = f"least({count - 1}, floor(sqrt((x + 0.5 - 128) * (x + 0.5 - 128) + (y + 0.5 - 128) * (y + 0.5 - 128)) / (128e0 / {count})))::BIGINT"
    means = (
        f"g AS (SELECT vec_id, {ring} AS ring, sum(v)::DOUBLE / count(*) AS m FROM u GROUP BY ALL), "
        f"a AS (SELECT vec_id, ring, coalesce(m, 0) AS m FROM (SELECT DISTINCT vec_id FROM g) CROSS JOIN range({count}) e(ring) LEFT JOIN g USING (vec_id, ring)), "
        f"c AS (SELECT vec_id, k - 1 AS k, sum(m * cos(pi() * (2 * ring + 1) * k / {2 * count}) * sqrt(2e0 / {count})) AS c FROM a, range(1, {keep + 1}) t(k) GROUP BY ALL), "
        f"m AS (SELECT vec_id, (list(c ORDER BY c))[{keep // 2 + 1}] AS m FROM c GROUP BY vec_id)"
    )
    return packed(f"{GRAY}, {resized('rz', 'px', 256, 256, Interpolation.BILINEAR)}, {blurred('u', 'rz', 256, im.blur_taps(0, 1.0))}, {means}", "SELECT vec_id, k, c > m AS bit FROM c JOIN m USING (vec_id)")


def zernike(degree: int = 8) -> str:
    terms = []
    for i, (n, m) in enumerate(ds.zernike_orders(degree)):
        for s in range((n - m) // 2 + 1):
            c = math.factorial(n - s) // (math.factorial(s) * math.factorial((n + m) // 2 - s) * math.factorial((n - m) // 2 - s))
            terms.append((i, n, m, (-1) ** s * c, n - 2 * s))
    return (
        f"WITH {GRAY}, {resized('rz', 'px', 64, 64, Interpolation.BILINEAR)}, "
        "z AS (SELECT y, x, (y - 31.5) / 32 AS fy, (x - 31.5) / 32 AS fx FROM range(64) a(y), range(64) b(x)), "
        f"e AS (SELECT y, x, i, n, sum(c * sqrt(fx * fx + fy * fy) ** q) AS f, max(cos(m * atan2(fy, fx))) AS re, max(-sin(m * atan2(fy, fx))) AS im FROM z, {table(terms, 't(i, n, m, c, q)')} WHERE fx * fx + fy * fy <= 1 GROUP BY ALL), "
        "s AS (SELECT vec_id, i, n, sum(v / 255e0 * f * re) AS re, sum(v / 255e0 * f * im) AS im FROM rz JOIN e USING (y, x) GROUP BY ALL), "
        "m AS (SELECT vec_id, i, sqrt(re * re + im * im) * (n + 1) / pi() AS m FROM s) "
        "SELECT a.vec_id, list(round(a.m / o.m, 9) + 0e0 ORDER BY a.i) AS hash FROM m a JOIN m o ON o.vec_id = a.vec_id AND o.i = 0 WHERE a.i > 0 GROUP BY a.vec_id"
    )


def colour_moment() -> str:
    planes = (
        "o AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d, (4899 * r + 9617 * g + 1868 * b + 8192) >> 14 AS lu FROM u), "
        "i AS (SELECT *, CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS raw, CASE WHEN v = 0 THEN 0 ELSE floor(255 * 4096.0 / v + 0.5) END AS sv, CASE WHEN d = 0 THEN 0 ELSE floor(30 * 4096.0 / d + 0.5) END AS sd FROM o), "
        "h AS (SELECT *, floor((raw * sd + 2048) / 4096.0) AS hue FROM i), "
        "f AS (SELECT vec_id, y, x, unnest([least(255, CASE WHEN hue < 0 THEN hue + 180 ELSE hue END), floor((d * sv + 2048) / 4096.0), v, least(255, lu), "
        "least(255, greatest(0, floor(((r - lu) * 11682 + 2097152 + 8192) / 16384.0))), least(255, greatest(0, floor(((b - lu) * 9241 + 2097152 + 8192) / 16384.0)))]::DOUBLE[]) AS p, unnest(range(6)) AS plane FROM h)"
    )
    moments = ", ".join(f"sum(p * x ** {i} * y ** {j}) AS m{i}{j}" for i in range(4) for j in range(4 - i))
    nu = (
        "c AS (SELECT *, CASE WHEN m00 > 0 THEN 1 / m00 ELSE 0 END AS inv, CASE WHEN m00 > 0 THEN m10 / m00 ELSE 0 END AS cx, CASE WHEN m00 > 0 THEN m01 / m00 ELSE 0 END AS cy FROM m), "
        "k AS (SELECT *, m20 - m10 * cx AS u20, m11 - m10 * cy AS u11, m02 - m01 * cy AS u02, inv * inv AS q2, inv * inv * sqrt(inv) AS q3 FROM c), "
        "n AS (SELECT vec_id, plane, u20 * q2 AS n20, u11 * q2 AS n11, u02 * q2 AS n02, (m30 - cx * (3 * u20 + cx * m10)) * q3 AS n30, (m21 - cx * (2 * u11 + cx * m01) - cy * u20) * q3 AS n21, "
        "(m12 - cy * (2 * u11 + cy * m10) - cx * u02) * q3 AS n12, (m03 - cy * (3 * u02 + cy * m01)) * q3 AS n03 FROM k), "
        "t AS (SELECT vec_id, plane, n20 + n02 AS sm, n20 - n02 AS e, 4 * n11 AS f, n11, n30 + n12 AS a, n21 + n03 AS b, n30 - 3 * n12 AS c, 3 * n21 - n03 AS d FROM n), "
        "w AS (SELECT *, a * (a * a - 3 * b * b) AS g, b * (3 * a * a - b * b) AS k FROM t)"
    )
    seven = "[sm, e * e + f * n11, c * c + d * d, a * a + b * b, c * g + d * k, e * (a * a - b * b) + f * a * b, d * g - c * k]"
    return (
        f"WITH {COLOUR}, {resized('rz', 'px', 64, 64, Interpolation.BICUBIC, RGB)}, {blurred('u', 'rz', 64, im.blur_taps(3, 0.0), RGB)}, {planes}, "
        f"m AS (SELECT vec_id, plane, {moments} FROM f GROUP BY ALL), {nu} "
        f"SELECT vec_id, flatten(list(list_transform({seven}, lambda v: round(v, 9) + 0e0) ORDER BY plane)) AS hash FROM w GROUP BY vec_id"
    )


def _places(name: str, source: str, terms: str, inner: str = "3, 61") -> str:
    """Terms over the pixels away from the border, of images as lists q."""
    return f"{name} AS (SELECT vec_id, (t.y)::INTEGER AS y, (u.x)::INTEGER AS x, {terms} FROM {source}, range({inner}) t(y), range({inner}) u(x))"


def _strongest(responses: str, radius: int, most: int) -> str:
    """Keypoints of a table o (vec_id, y, x, r) of positive responses, and of images as lists q."""
    return (
        f"{responses}, n AS (SELECT a.vec_id, a.y, a.x, a.r, max(CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE coalesce(o.r, 0) END) AS near FROM o a CROSS JOIN range(-1, 2) f(dy) CROSS JOIN range(-1, 2) g(dx) "
        "LEFT JOIN o ON o.vec_id = a.vec_id AND o.y = a.y + dy AND o.x = a.x + dx GROUP BY ALL), "
        f"k AS (SELECT vec_id, y, x, r, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, y, x)::INTEGER AS rank FROM n WHERE near < r AND y BETWEEN {radius} AND {63 - radius} AND x BETWEEN {radius} AND {63 - radius}), "
        f"w AS (SELECT k.vec_id, rank, x, y, r, sum(dy * q[((y + dy) * 64 + x + dx + 1)::INTEGER]) AS down, sum(dx * q[((y + dy) * 64 + x + dx + 1)::INTEGER]) AS along "
        f"FROM k JOIN i USING (vec_id), range({-radius}, {radius + 1}) f(dy), range({-radius}, {radius + 1}) g(dx) WHERE rank <= {most} GROUP BY ALL)"
    )


_KEYPOINTS = " SELECT vec_id AS id, rank, x, y, r::DOUBLE AS response, round(atan2(down, along), 6) AS angle FROM w"


def _lists(name: str, source: str, out: str = "q") -> str:
    return f"{name} AS (SELECT vec_id, list(v::INTEGER ORDER BY y, x) AS {out} FROM {source} GROUP BY vec_id)"


def _fast(most: int) -> str:
    offsets = "[" + ", ".join(str(64 * dy + dx) for dx, dy in ds.FAST_CIRCLE) + "]"
    mask = lambda test: f"list_sum(list_transform(range(16), lambda k: CASE WHEN ring[CAST(k + 1 AS INTEGER)] {test} THEN 1 << k::INTEGER ELSE 0 END))::BIGINT"
    run = lambda m: f"len(list_filter(range(16), lambda k: ((({m} | ({m} << 16)) >> k::INTEGER) & 511) = 511)) > 0"
    return f"WITH {GRAY}, {resized('rz', 'px', 64, 64, Interpolation.BILINEAR)}, {_lists('i', 'rz')}, " + _strongest(
        _places("c", "i", f"q[(t.y * 64 + u.x + 1)::INTEGER] AS c, list_transform({offsets}, lambda o: q[(t.y * 64 + u.x + 1 + o)::INTEGER]) AS ring")
        + f", m AS (SELECT vec_id, y, x, {mask(f'>= c + {ds.FAST_THRESHOLD}')} AS up, {mask(f'<= c - {ds.FAST_THRESHOLD}')} AS down, list_sum(list_transform(ring, lambda v: abs(v - c))) AS r FROM c), "
        f"o AS (SELECT vec_id, y, x, r FROM m WHERE r > 0 AND ({run('up')} OR {run('down')}))",
        ds.FEATURES[Feature.ORB][0],
        most,
    )


def _hessian(most: int) -> str:
    at = lambda k, dy, dx: f"q{k}[((t.y + {dy}) * 64 + u.x + {dx} + 1)::INTEGER]"
    parts, terms = [], []
    for k, sigma in enumerate(ds.AKAZE_SCALES):
        parts += [blurred(f"s{k}", "rz", 64, im.blur_taps(0, sigma)), _lists(f"i{k}", f"s{k}", f"q{k}")]
        xx, yy = (f"({at(k, *a)} + {at(k, *b)} - 2 * {at(k, 0, 0)})" for a, b in (((0, 1), (0, -1)), ((1, 0), (-1, 0))))
        xy = f"(({at(k, 1, 1)} - {at(k, 1, -1)} - {at(k, -1, 1)} + {at(k, -1, -1)}) * 0.25e0)"
        terms.append(f"abs({xx} * {yy} - {xy} * {xy}) * {sigma:.1f}e0 * {sigma:.1f}e0 AS r{k}")
    best = "greatest(CASE WHEN r1 <= r0 THEN r0 ELSE 0 END, CASE WHEN r0 <= r1 AND r2 <= r1 THEN r1 ELSE 0 END, CASE WHEN r1 <= r2 THEN r2 ELSE 0 END)"
    return f"WITH {GRAY}, {resized('rz', 'px', 64, 64, Interpolation.BILINEAR)}, {_lists('i', 'rz')}, {', '.join(parts)}, " + _strongest(
        _places("c", "(SELECT vec_id, q0, q1, q2 FROM i0 JOIN i1 USING (vec_id) JOIN i2 USING (vec_id))", ", ".join(terms)) + f", o AS (SELECT vec_id, y, x, {best} AS r FROM c WHERE {best} > 0)",
        ds.FEATURES[Feature.AKAZE][0],
        most,
    )


def _words(feature: Feature = Feature.ORB, vocabulary: int = 256, most: int = 500) -> str:
    """Named d: the visual words (vec_id, word, n) of the images' keypoints, from pixels or, for AKAZE, from sums of
    3 x 3 pixels of a blurred image."""
    radius, seed = ds.FEATURES[feature][1:]
    pairs = table([(k, *map(int, row)) for k, row in enumerate(ds.sampling_pairs(radius, seed))], "p(k, x1, y1, x2, y2)")
    inside = lambda i: f"(CASE WHEN abs({i}) % 126 < 64 THEN abs({i}) % 126 ELSE 126 - abs({i}) % 126 END)"
    value = lambda n: f"q[({inside(f'(y + round(s * x{n} + c * y{n}))::BIGINT')} * 64 + {inside(f'(x + round(c * x{n} - s * y{n}))::BIGINT')} + 1)::INTEGER]"
    pixels, source = "", "i"
    if feature == Feature.AKAZE:
        three = np.zeros((64, 64))
        for at in range(64):
            np.add.at(three[at], im.reflect(np.arange(at - 1, at + 2), 64), 1)
        pixels = f", {blurred('bl', 'rz', 64, im.blur_taps(0, 1.2))}, {_one_axis('th_a', 'bl', 'x', three, ('v',))}, {_one_axis('th', 'th_a', 'y', three, ('v',))}, {_lists('j', 'th')}"
        source = "j"
    return (
        f"{(_hessian if feature == Feature.AKAZE else _fast)(most)}{pixels}, t AS (SELECT vec_id, rank, x, y, cos(atan2(down, along)) AS c, sin(atan2(down, along)) AS s FROM w), "
        f"b AS (SELECT vec_id, rank, k // 8 AS place, sum(CASE WHEN {value(1)} < {value(2)} THEN 1 << (k % 8)::INTEGER ELSE 0 END)::BIGINT AS byte FROM t JOIN {source} USING (vec_id), {pairs} GROUP BY ALL), "
        "f AS (SELECT vec_id, rank, list_reduce(list(byte ORDER BY place), lambda h, v: (xor(h, v) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM b GROUP BY vec_id, rank), "
        f"d AS (SELECT vec_id, h % {vocabulary} AS word, count(*)::DOUBLE AS n FROM f GROUP BY ALL)"
    )


def word_simhash(bits: int = 128, vocabulary: int = 256) -> str:
    signs = "[" + ", ".join("[" + ", ".join(str(int(v)) for v in row) + "]" for row in ds.simhash_signs(vocabulary, bits).T) + "]"
    return packed(
        f"{_words(Feature.AKAZE)[5:]}, hi AS (SELECT r.vec_id, list(coalesce(n, 0) ORDER BY g.word) AS h FROM r CROSS JOIN range({vocabulary}) g(word) LEFT JOIN d ON d.vec_id = r.vec_id AND d.word = g.word GROUP BY r.vec_id), "
        f"si AS (SELECT vec_id, list_transform({signs}, lambda s: list_sum(list_transform(range({vocabulary}), lambda k: h[CAST(k + 1 AS INTEGER)] * s[CAST(k + 1 AS INTEGER)])) > 0) AS bits FROM hi)",
        f"SELECT vec_id, (t.k)::INTEGER AS k, bits[(t.k + 1)::INTEGER] AS bit FROM si, range({bits}) t(k)",
    )


def word_histogram(vocabulary: int = 256) -> str:
    return (
        f"{_words(vocabulary=vocabulary)}, e AS (SELECT vec_id, sqrt(sum(n * n)) AS norm FROM d GROUP BY vec_id) "
        f"SELECT r.vec_id, list(round(coalesce(n / norm, 0), 9) ORDER BY g.word) AS hash FROM r CROSS JOIN range({vocabulary}) g(word) LEFT JOIN d ON d.vec_id = r.vec_id AND d.word = g.word LEFT JOIN e ON e.vec_id = r.vec_id GROUP BY r.vec_id"
    )


def word_minhash(size: int = 64) -> str:
    factors = "[" + ", ".join(f"[{a}::HUGEINT, {c}::HUGEINT]" for a, c in ds.minhash_factors(size)) + "]"
    least = f"least(list_min(list_transform(words, lambda w: (f[1] * w + f[2]) % {ds.MINHASH_PRIME})), {ds.MINHASH_PRIME - 1})::DOUBLE"
    return f"{_words()}, e AS (SELECT vec_id, list(word) AS words FROM d GROUP BY vec_id) SELECT r.vec_id, list_transform({factors}, lambda f: CASE WHEN words IS NULL THEN 0e0 ELSE {least} END) AS hash FROM r LEFT JOIN e USING (vec_id)"


SQL = {
    "average_image": average(),
    "median_image": median(),
    "difference_image": difference(),
    "phash_image": phash(),
    "whash_image": wavelet(),
    "block_mean_image": block_mean(),
    "block_mean_rotation": turned(False),
    "block_mean_rotation_overlap": turned(True),
    "pdq": pdq(),
    "radial_scaled": radial(),
    "color_moment": colour_moment(),
    "cld_desc": layout(),
    "ehd_hist": edges(),
    "zernike": zernike(),
    "jarosz": jarosz_query(),
    "log_filter": log_filter(),
    "lbp_image": binary_patterns(),
    "rash": rings(),
    "orb_keypoints": _fast(50) + _KEYPOINTS,
    "akaze_keypoints": _hessian(50) + _KEYPOINTS,
    "bovw_hist": word_histogram(),
    "bovw_minhash": word_minhash(),
    "bovw_simhash": word_simhash(),
}

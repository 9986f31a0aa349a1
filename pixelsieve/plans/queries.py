"""Queries of the engine over the test tables, and the same in SQL where SQL can say it.

There are no images among the tables. Rasters are made of them: R8 turns each row of `embeddings` into an 8 x 8
gray image, and colours come from numeric columns of `lineitem`. Every query covers whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.functions import hashes as hs
from pixelsieve.functions import metrics
from pixelsieve.functions import raster as rs
from pixelsieve.kernels import descriptors as ds
from pixelsieve.kernels import imaging as im
from pixelsieve.operators import hashers as hh
from pixelsieve.operators import kernel_columns as kc
from pixelsieve.operators import rasterize as rz
from pixelsieve.operators import similarity as sim
from pixelsieve.plans import image_sql
from pixelsieve.plans.sql import R8
from pixelsieve.plans.sql import numbers as _numbers
from pixelsieve.sources.images import colour_raster, gray_raster
from pixelsieve.types import BlockMethod, Feature, Interpolation, Kind, Storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


# Inputs


def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and p: 64 gray pixels."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pixel = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5))).cast("int")
    return rows.select("vec_id", "label", F.transform("embedding", pixel).alias("p"))


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hh.spread(r8(spark, sf_dir)).select("vec_id", "label", gray_raster(F.col("p"), 8, 8).alias("raster"))


def colour_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red is R8, green R8 backwards, blue R8 turned upside down in brightness."""
    rows = hh.spread(r8(spark, sf_dir))
    return rows.select("vec_id", colour_raster(F.col("p"), F.reverse("p"), F.transform("p", lambda v: 255 - v), 8, 8).alias("raster"))


def _bytes(bits: str, high_first: bool = False) -> str:
    """SQL: a list of booleans as the string of its bytes."""
    weight = "(128 >> i)" if high_first else "(1 << i)"
    byte = f"list_sum(list_transform(range(8), lambda i: CASE WHEN coalesce(({bits})[CAST(b * 8 + i + 1 AS INTEGER)], false) THEN {weight} ELSE 0 END))"
    return f"'[' || array_to_string(list_transform(range(CAST(ceil(len({bits}) / 8.0) AS BIGINT)), lambda b: CAST({byte} AS INTEGER)), ' ') || ']'"


def _packed(cte: str, source: str, bits: str = "bits", key: str = "vec_id") -> str:
    return f"WITH {cte} SELECT {key}, {_bytes(bits)} AS hash FROM {source}"


def _rounded(column, digits: int = 6):
    return F.transform(column, lambda v: F.round(v, digits) + 0.0)


# Thresholded hashes


@_query("avg_hash", _packed(R8 + ", b AS (SELECT vec_id, list_transform(p, lambda v: v > round(list_avg(p))) AS bits FROM r)", "b"))
def avg_hash(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.average_hash(F.col("p"))).alias("hash"))


@_query("diff_hash", _packed(R8 + ", b AS (SELECT vec_id, list_transform(range(56), lambda k: p[CAST((k // 7) * 8 + k % 7 + 2 AS INTEGER)] > p[CAST((k // 7) * 8 + k % 7 + 1 AS INTEGER)]) AS bits FROM r)", "b"))
def diff_hash(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.difference_hash(F.col("p"), 8, 8)).alias("hash"))


@_query("median_hash", _packed(R8 + ", s AS (SELECT *, list_sort(p) AS s FROM r), b AS (SELECT vec_id, list_transform(p, lambda v: v > round((s[32] + s[34]) / 2.0)) AS bits FROM s)", "b"))
def median_hash(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.median_hash(F.col("p"))).alias("hash"))


def _block_sql(side: int, step: int) -> str:
    n = (8 - side) // step + 1
    cell = " + ".join(f"p[CAST((k // {n}) * {step * 8} + (k % {n}) * {step} + {y * 8 + x + 1} AS INTEGER)]" for y in range(side) for x in range(side))
    return f"list_transform(range({n * n}), lambda k: ({cell}) / {float(side * side)})"


@_query("block_mean_direct", _packed(R8 + f", b AS (SELECT vec_id, list_transform({_block_sql(2, 2)}, lambda v: v >= list_avg(p)) AS bits FROM r)", "b"))
def block_mean_direct(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.block_mean_hash(F.col("p"), 8, 8, 2, 2)).alias("hash"))


@_query("block_mean_overlap", _packed(R8 + f", b AS (SELECT vec_id, list_transform({_block_sql(2, 1)}, lambda v: v >= list_avg(p)) AS bits FROM r)", "b"))
def block_mean_overlap(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.block_mean_hash(F.col("p"), 8, 8, 2, 2, True)).alias("hash"))


@_query("wavelet_hash", _packed(R8 + f", l AS (SELECT vec_id, {_block_sql(2, 2)} AS l FROM r), b AS (SELECT vec_id, list_transform(l, lambda v: v > list_median(l)) AS bits FROM l)", "b"))
def wavelet_hash(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.wavelet_hash(F.col("p"), 8, 8, 1)).alias("hash"))


def _dct_sql(keep: int) -> str:
    c = im.dct_matrix(8)
    rows = "[" + ", ".join(_numbers([c[u][y] * c[v][x] for y in range(8) for x in range(8)]) for u in range(keep) for v in range(keep)) + "]"
    return f"list_transform({rows}, lambda w: list_sum(list_transform(range(64), lambda k: p[CAST(k + 1 AS INTEGER)] * w[CAST(k + 1 AS INTEGER)])))"


@_query("dct2d", f"WITH {R8} SELECT vec_id, list_transform({_dct_sql(4)}, lambda v: round(v, 6) + 0e0) AS coefficients FROM r")
def dct2d(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", _rounded(rs.dct2(F.col("p"), 8, 8, 4)).alias("coefficients"))


@_query("dct1d", f"WITH {R8} SELECT vec_id, list_transform([{', '.join(_numbers(r) for r in im.dct_matrix(64)[:8])}], lambda w: round(list_sum(list_transform(range(64), lambda k: p[CAST(k + 1 AS INTEGER)] * w[CAST(k + 1 AS INTEGER)])), 6) + 0e0) AS coefficients FROM r")
def dct1d(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", _rounded(rs.dct1(F.col("p"), 64, 8)).alias("coefficients"))


@_query("phash", _packed(R8 + f", c AS (SELECT vec_id, {_dct_sql(8)} AS c FROM r), d AS (SELECT vec_id, list_transform(range(64), lambda k: CASE WHEN k = 0 THEN 0.0 ELSE c[CAST(k + 1 AS INTEGER)] END) AS c FROM c), b AS (SELECT vec_id, list_transform(c, lambda v: v > list_avg(c)) AS bits FROM d)", "b"))
def phash(spark, sf_dir):
    hasher = hh.PHash(width=8, height=8)
    return gray_images(spark, sf_dir).select("vec_id", hs.hash_to_string(hasher.hash("raster")).alias("hash"))


@_query("haar_ll", f"WITH {R8} SELECT vec_id, {_block_sql(4, 4)} AS low FROM r")
def haar_ll(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", rs.haar_low(F.col("p"), 8, 8, 2).alias("low"))


# Statistics, histograms and moments


@_query("gray_mean", f"WITH {R8} SELECT vec_id, list_avg(p) AS mean FROM r")
def gray_mean(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", rs.gray_mean(F.col("p")).alias("mean"))


@_query("gray_median", f"WITH {R8}, s AS (SELECT vec_id, list_sort(p) AS s FROM r) SELECT vec_id, (s[32] + s[34]) / 2.0 AS median FROM s")
def gray_median(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", rs.gray_median(F.col("p")).alias("median"))


_LBP_SQL = " + ".join(
    f"(CASE WHEN k % 8 + {dx} BETWEEN 0 AND 7 AND k // 8 + {dy} BETWEEN 0 AND 7 AND p[CAST(k + {dy * 8 + dx + 1} AS INTEGER)] >= p[CAST(k + 1 AS INTEGER)] THEN {1 << i} ELSE 0 END)" for i, (dx, dy) in enumerate(ds.LBP_NEIGHBOURS)
)
_LBP_CODES = f"c AS (SELECT vec_id, list_transform(range(64), lambda k: {_LBP_SQL}) AS codes FROM r)"


@_query("lbp_codes", f"WITH {R8}, {_LBP_CODES} SELECT vec_id, list_transform(codes, lambda x: CAST(x AS INTEGER)) AS codes FROM c")
def lbp_codes(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", rs.lbp_codes(F.col("p"), 8, 8).alias("codes"))


@_query(
    "lbp_hist",
    f"WITH {R8}, {_LBP_CODES}, h AS (SELECT vec_id, list_transform(range(256), lambda v: len(list_filter(codes, lambda x: x = v))) AS h FROM c) "
    "SELECT vec_id, list_transform(h, lambda n: CAST(floor(n * 255.0 / list_max(h)) AS INTEGER)) AS hash FROM h",
)
def lbp_hist(spark, sf_dir):
    return gray_images(spark, sf_dir).select("vec_id", hh.LBP(width=8, height=8).hash("raster").alias("hash"))


_MOMENTS = ", ".join(f"list_sum(list_transform(range(64), lambda k: p[CAST(k + 1 AS INTEGER)] * pow(k % 8, {i}) * pow(k // 8, {j}))) AS m{i}{j}" for i in range(4) for j in range(4 - i))


@_query("raw_moments", f"WITH {R8} SELECT vec_id, {_MOMENTS} FROM r")
def raw_moments(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", rs.raw_moments(F.col("p"), 8).alias("m")).select("vec_id", "m.*")


@_query(
    "hu_moments",
    f"""WITH {R8}, m AS (SELECT vec_id, {_MOMENTS} FROM r), c AS (SELECT *, 1 / m00 AS inv, m10 / m00 AS cx, m01 / m00 AS cy FROM m),
u AS (SELECT *, m20 - m10 * cx AS u20, m11 - m10 * cy AS u11, m02 - m01 * cy AS u02 FROM c),
n AS (SELECT vec_id, u20 * inv * inv AS n20, u11 * inv * inv AS n11, u02 * inv * inv AS n02, inv * inv * sqrt(inv) AS s,
  m30 - cx * (3 * u20 + cx * m10) AS u30, m21 - cx * (2 * u11 + cx * m01) - cy * u20 AS u21,
  m12 - cy * (2 * u11 + cy * m10) - cx * u02 AS u12, m03 - cy * (3 * u02 + cy * m01) AS u03 FROM u),
t AS (SELECT vec_id, n20, n11, n02, u30 * s AS n30, u21 * s AS n21, u12 * s AS n12, u03 * s AS n03 FROM n)
SELECT vec_id, round((n20 + n02) * 1e4, 6) AS h1, round((pow(n20 - n02, 2) + 4 * n11 * n11) * 1e8, 5) + 0.0 AS h2,
  round((pow(n30 - 3 * n12, 2) + pow(3 * n21 - n03, 2)) * 1e10, 4) + 0.0 AS h3,
  round((pow(n30 + n12, 2) + pow(n21 + n03, 2)) * 1e10, 4) + 0.0 AS h4 FROM t WHERE true""",
)
def hu_moments(spark, sf_dir):
    hu = kc.vector_column("raster", lambda x: im.hu_moments(im.to_gray(x)))
    rows = gray_images(spark, sf_dir).select("vec_id", hu.alias("h"))
    scaled = [(1, 1e4, 6), (2, 1e8, 5), (3, 1e10, 4), (4, 1e10, 4)]
    return rows.select("vec_id", *[(F.round(F.element_at("h", k) * s, d) + 0.0).alias(f"h{k}") for k, s, d in scaled])


_RING = "CAST(least(3, floor(sqrt(pow(k % 8 + 0.5 - 4, 2) + pow(k // 8 + 0.5 - 4, 2)) / 1.0)) AS INTEGER)"


@_query(
    "ring_mean",
    f"WITH {R8}, g AS (SELECT vec_id, list_transform(range(4), lambda g: list_avg(list_transform(list_filter(range(64), lambda k: {_RING} = g), lambda k: p[CAST(k + 1 AS INTEGER)]))) AS m FROM r) "
    "SELECT vec_id, list_transform(m, lambda v: round(v, 6)) AS means FROM g",
)
def ring_mean(spark, sf_dir):
    means = kc.vector_column("raster", lambda x: ds.ring_means(im.to_gray(x), 4))
    return gray_images(spark, sf_dir).select("vec_id", _rounded(means).alias("means"))


@_query(
    "equalize_hist",
    f"""WITH {R8}, m AS (SELECT vec_id, p, list_min(p) AS lo, len(list_filter(p, lambda v: v = list_min(p))) AS n FROM r)
SELECT vec_id, list_transform(p, lambda v: CASE WHEN v = lo THEN 0 ELSE CAST(least(255, round(CAST(CAST(len(list_filter(p, lambda u: u > lo AND u <= v)) AS FLOAT)
  * (CAST(255 AS FLOAT) / CAST(64 - n AS FLOAT)) AS DOUBLE))) AS INTEGER) END) AS pixels FROM m""",
)
def equalize_hist(spark, sf_dir):
    out = kc.vector_column("raster", lambda x: im.equalize(im.to_gray(x)).reshape(len(x), -1), "array<int>")
    return gray_images(spark, sf_dir).select("vec_id", out.alias("pixels"))


def _mirror(k: int) -> int:
    return -k if k < 0 else 14 - k if k > 7 else k


_BLUR = "[" + ", ".join("[" + ", ".join(str(_mirror(y + dy) * 8 + _mirror(x + dx) + 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + "]" for y in range(8) for x in range(8)) + "]"


@_query(
    "gauss_blur",
    f"WITH {R8} SELECT vec_id, list_transform({_BLUR}, lambda a: (list_sum(list_transform(range(9), lambda k: p[a[CAST(k + 1 AS INTEGER)]] * [1, 2, 1, 2, 4, 2, 1, 2, 1][CAST(k + 1 AS INTEGER)])) * 4096 + 32768)::INTEGER >> 16) AS pixels FROM r",
)
def gauss_blur(spark, sf_dir):
    out = kc.vector_column("raster", lambda x: im.gaussian_blur(im.to_gray(x), 3, 0.0).reshape(len(x), -1), "array<int>")
    return gray_images(spark, sf_dir).select("vec_id", out.alias("pixels"))


_EDGES = """e AS (SELECT vec_id, list_transform(range(16), lambda c: [p[CAST((c // 4) * 16 + (c % 4) * 2 + 1 AS INTEGER)], p[CAST((c // 4) * 16 + (c % 4) * 2 + 2 AS INTEGER)],
  p[CAST((c // 4) * 16 + (c % 4) * 2 + 9 AS INTEGER)], p[CAST((c // 4) * 16 + (c % 4) * 2 + 10 AS INTEGER)]]) AS q FROM r),
f AS (SELECT vec_id, list_transform(q, lambda v: [abs(v[1] - v[2] + v[3] - v[4]), abs(v[1] + v[2] - v[3] - v[4]), abs(sqrt(2) * (v[1] - v[4])), abs(sqrt(2) * (v[2] - v[3])), abs(2.0 * (v[1] - v[2] - v[3] + v[4]))]) AS q FROM e)"""


@_query("ehd_edges", f"WITH {R8}, {_EDGES} SELECT vec_id, list_transform(q, lambda v: CASE WHEN list_max(v) >= 11 THEN CAST(list_position(v, list_max(v)) AS INTEGER) ELSE 0 END) AS edge FROM f")
def ehd_edges(spark, sf_dir):
    """The edge type (1 to 5, 0 for none) of each 2 x 2 block."""

    def types(x):
        shares = ds.edge_shares(im.to_gray(x))
        return (shares.argmax(axis=2) + 1) * (shares.max(axis=2) > 0)

    return gray_images(spark, sf_dir).select("vec_id", kc.vector_column("raster", types, "array<int>").alias("edge"))


@_query("ehd_hist", image_sql.SQL["ehd_hist"])
def ehd_hist(spark, sf_dir):
    return gray_images(spark, sf_dir).select("vec_id", hh.EHD().hash("raster").alias("hash"))


@_query(
    "hog_gradients",
    f"""WITH {R8}, g AS (SELECT vec_id, list_transform(range(64), lambda k: [p[CAST((k // 8) * 8 + least(7, k % 8 + 1) + 1 AS INTEGER)] - p[CAST((k // 8) * 8 + greatest(0, k % 8 - 1) + 1 AS INTEGER)],
  p[CAST(least(7, k // 8 + 1) * 8 + k % 8 + 1 AS INTEGER)] - p[CAST(greatest(0, k // 8 - 1) * 8 + k % 8 + 1 AS INTEGER)]]) AS d FROM r)
SELECT vec_id, list_transform(d, lambda v: round(sqrt(v[1] * v[1] + v[2] * v[2]), 6)) AS magnitude,
  list_transform(d, lambda v: CASE WHEN v[2] = 0 THEN 0.0 WHEN degrees(atan2(v[2], v[1])) < 0 THEN round(degrees(atan2(v[2], v[1])) + 180, 6) ELSE round(degrees(atan2(v[2], v[1])), 6) END) AS angle FROM g""",
)
def hog_gradients(spark, sf_dir):
    both = kc.vector_column("raster", lambda x: kc.side_by_side(*ds.gradients(im.to_gray(x))))
    rows = gray_images(spark, sf_dir).select("vec_id", both.alias("g"))
    return rows.select("vec_id", _rounded(F.slice("g", 1, 64)).alias("magnitude"), _rounded(F.slice("g", 65, 64)).alias("angle"))


# Colour


def _lineitem_colours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 7 % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))


_COLOURS = "c AS (SELECT l_orderkey, l_linenumber, (l_partkey % 256)::BIGINT AS r, (l_suppkey * 7 % 256)::BIGINT AS g, (l_orderkey % 256)::BIGINT AS b FROM lineitem)"


@_query("gray_luma", f"WITH {_COLOURS} SELECT l_orderkey, l_linenumber, ((19595 * r * 257 + 38470 * g * 257 + 7471 * b * 257 + 32768) >> 24)::INTEGER AS gray FROM c")
def gray_luma(spark, sf_dir):
    return _lineitem_colours(spark, sf_dir).select("l_orderkey", "l_linenumber", rs.gray_luma(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


@_query(
    "ycrcb",
    f"""WITH {_COLOURS}, y AS (SELECT *, (4899 * r + 9617 * g + 1868 * b + 8192) >> 14 AS y FROM c)
SELECT l_orderkey, l_linenumber, least(255, y)::INTEGER AS y, least(255, greatest(0, floor(((r - y) * 11682 + 2097152 + 8192) / 16384.0)))::INTEGER AS cr,
  least(255, greatest(0, floor(((b - y) * 9241 + 2097152 + 8192) / 16384.0)))::INTEGER AS cb FROM y""",
)
def ycrcb(spark, sf_dir):
    rows = _lineitem_colours(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", rs.ycrcb(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@_query(
    "hsv",
    f"""WITH {_COLOURS}, x AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM c),
h AS (SELECT *, CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS raw,
  CASE WHEN v = 0 THEN 0 ELSE floor(255 * 4096.0 / v + 0.5) END AS sv, CASE WHEN d = 0 THEN 0 ELSE floor(30 * 4096.0 / d + 0.5) END AS sd FROM x),
k AS (SELECT *, floor((raw * sd + 2048) / 4096.0) AS hue FROM h)
SELECT l_orderkey, l_linenumber, (CASE WHEN hue < 0 THEN hue + 180 ELSE hue END)::INTEGER AS h, floor((d * sv + 2048) / 4096.0)::INTEGER AS s, v::INTEGER AS v FROM k""",
)
def hsv(spark, sf_dir):
    rows = _lineitem_colours(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", rs.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


# Resampling: 8 x 8 to 5 x 11


def _resize_sql(interpolation: Interpolation) -> str:
    lists = lambda m: "[" + ", ".join(_numbers(row) for row in m) + "]"
    across, down = lists(im.resampling_weights(8, 5, interpolation)), lists(im.resampling_weights(8, 11, interpolation))
    one = "list_sum(list_transform(range(8), lambda k: p[CAST(y * 8 + k + 1 AS INTEGER)] * w[CAST(k + 1 AS INTEGER)]))"
    two = "list_sum(list_transform(range(8), lambda k: t[CAST(k + 1 AS INTEGER)][CAST(x + 1 AS INTEGER)] * w[CAST(k + 1 AS INTEGER)]))"
    return (
        f"WITH {R8}, a AS (SELECT vec_id, list_transform(range(8), lambda y: list_transform({across}, lambda w: {one})) AS t FROM r) "
        f"SELECT vec_id, flatten(list_transform({down}, lambda w: list_transform(range(5), lambda x: greatest(0, least(65535, floor({two} * 257 + 0.5)))::INTEGER >> 8))) AS pixels FROM a"
    )


def _resize_query(interpolation: Interpolation):
    def run(spark, sf_dir):
        return r8(spark, sf_dir).select("vec_id", rs.resample(F.col("p"), 8, 8, 5, 11, interpolation).alias("pixels"))

    return run


for _i, _name in [
    (Interpolation.NEAREST, "nearest"), (Interpolation.BILINEAR, "bilinear"), (Interpolation.BICUBIC, "bicubic"), (Interpolation.MITCHELL_NETRAVALI, "mitchell"),
    (Interpolation.LANCZOS2, "lanczos2"), (Interpolation.LANCZOS3, "lanczos3"), (Interpolation.BILINEAR_EXACT, "bilinear_exact"),
]:
    _query(f"resize_{_name}", _resize_sql(_i))(_resize_query(_i))


# Metrics, of R8 rows with one label


def _pairs(spark, sf_dir, *columns):
    return sim.pairs_within(hh.spread(r8(spark, sf_dir)), "label", "vec_id", list(columns) or ["p"])


def _hash_pairs(spark, sf_dir):
    rows = hh.spread(r8(spark, sf_dir)).select("vec_id", "label", rs.average_hash(F.col("p")).alias("h"))
    return sim.pairs_within(rows, "label", "vec_id", ["h"])


_PAIRS = R8 + ", q AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.p AS x, b.p AS y FROM r a JOIN r b ON a.label = b.label AND a.vec_id < b.vec_id)"
_BITS = R8 + """, w AS (SELECT vec_id, label, list_transform(p, lambda v: (v > round(list_avg(p)))::INTEGER) AS p FROM r),
q AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.p AS x, b.p AS y FROM w a JOIN w b ON a.label = b.label AND a.vec_id < b.vec_id)"""


def _sum_sql(term: str, n: int = 64) -> str:
    return f"list_sum(list_transform(range({n}), lambda k: {term.replace('X', 'x[CAST(k + 1 AS INTEGER)]').replace('Y', 'y[CAST(k + 1 AS INTEGER)]')}))"


def _metric_query(name: str, sql: str, fn, source=_pairs, cte: str = _PAIRS, column: str = "p"):
    def run(spark, sf_dir):
        rows = source(spark, sf_dir)
        return rows.select("id_a", "id_b", (F.round(fn(F.col(f"{column}_a"), F.col(f"{column}_b")), 9) + 0.0).alias("distance"))

    _query(name, f"WITH {cte} SELECT id_a, id_b, round({sql}, 9) + 0.0 AS distance FROM q")(run)


def _block_query(name: str, sql: str, metric, digits: int = 9):
    """As _metric_query, by the metric's matrices."""

    def run(spark, sf_dir):
        return sim.compared_within(r8(spark, sf_dir), "label", "vec_id", "p", metrics.MATRICES[metric], digits)

    _query(name, sql)(run)


def _rounded_pairs(sql: str) -> str:
    return f"WITH {_PAIRS} SELECT id_a, id_b, round({sql}, 9) + 0.0 AS distance FROM q"


_metric_query("hamming", _sum_sql("abs(X - Y)::DOUBLE"), metrics.hamming, _hash_pairs, _BITS, "h")
_WEIGHTS = (1.0, 2.0, 0.5, 1.0, 3.0, 1.0, 0.25, 1.5)
_metric_query("weighted_hamming", _sum_sql(f"abs(X - Y) * {_numbers(_WEIGHTS)}[CAST(k // 8 + 1 AS INTEGER)]"), lambda a, b: metrics.weighted_hamming(a, b, _WEIGHTS), _hash_pairs, _BITS, "h")
# Of unequal lengths: Hamming cuts the longer hash, Jaccard counts its bits as other ones
_CUT = _BITS.replace("b.p AS y", "b.p[1:40] AS y")
_metric_query("hamming_uneven", _sum_sql("abs(X - Y)::DOUBLE", 40), lambda a, b: metrics.hamming(a, F.slice(b, 1, 5)), _hash_pairs, _CUT, "h")
_metric_query("jaccard_uneven", f"CASE WHEN {_sum_sql('greatest(X, coalesce(Y, 0))::DOUBLE')} = 0 THEN 0 ELSE 1 - {_sum_sql('(X * coalesce(Y, 0))::DOUBLE')} / {_sum_sql('greatest(X, coalesce(Y, 0))::DOUBLE')} END", lambda a, b: metrics.jaccard(a, F.slice(b, 1, 5)), _hash_pairs, _CUT, "h")
_metric_query("l1", _sum_sql("abs(X - Y)::DOUBLE"), metrics.l1)
_metric_query("l2", f"sqrt({_sum_sql('((X - Y) * (X - Y))::DOUBLE')})", metrics.l2)
_block_query("cosine", _rounded_pairs(f"1 - {_sum_sql('(X * Y)::DOUBLE')} / (sqrt({_sum_sql('(X * X)::DOUBLE')}) * sqrt({_sum_sql('(Y * Y)::DOUBLE')}))"), metrics.cosine)
_block_query("chi_square", _rounded_pairs(_sum_sql("CASE WHEN X + Y = 0 THEN 0.0 ELSE ((X - Y) * (X - Y))::DOUBLE / (X + Y) END")), metrics.chi_square)
_metric_query("jaccard_bits", f"CASE WHEN {_sum_sql('greatest(X, Y)::DOUBLE')} = 0 THEN 0 ELSE 1 - {_sum_sql('(X * Y)::DOUBLE')} / {_sum_sql('greatest(X, Y)::DOUBLE')} END", metrics.jaccard, _hash_pairs, _BITS, "h")
_metric_query("jaccard_sig", f"1 - {_sum_sql('CASE WHEN X = Y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} / 64", lambda a, b: metrics.jaccard(a, b, Kind.UINT8))
_block_query("generic_compare", _rounded_pairs(f"sqrt({_sum_sql('((X - Y) * (X - Y))::DOUBLE')})"), metrics.compared_by(Kind.UINT8, Kind.FLOAT64))
_metric_query("distance_override", _sum_sql("abs(X - Y)::DOUBLE"), lambda a, b: hh.CLD(metric=metrics.l1).distance(a, b))


_PCC = _PAIRS + """,
m AS (SELECT id_a, id_b, list_transform(x, lambda v: (v::FLOAT - list_avg(x)::FLOAT)::DOUBLE) AS x, list_transform(y, lambda v: (v::FLOAT - list_avg(y)::FLOAT)::DOUBLE) AS y, list_stddev_pop(x) * list_stddev_pop(y) + 1e-20 AS s FROM q)"""


_block_query("pcc", f"WITH {_PCC} SELECT id_a, id_b, round(list_max(list_transform(range(64), lambda t: {_sum_sql('X * y[CAST((k - t + 64) % 64 + 1 AS INTEGER)]')} / 64 / s)), 6) AS distance FROM m", metrics.pcc, 6)


@_query(
    "hash_functions",
    f"WITH {R8}, w AS (SELECT vec_id, label, p, list_transform(p, lambda v: v > round(list_avg(p))) AS bits FROM r) SELECT vec_id, {_bytes('bits')} AS text, 8 AS length, "
    "list_sum(list_transform(range(8), lambda i: CASE WHEN bits[CAST(i + 17 AS INTEGER)] THEN 1 << i ELSE 0 END))::DOUBLE AS third, true AS same, [128, 0, 0, 2] AS marked FROM w",
)
def hash_functions(spark, sf_dir):
    """Text, length, a byte, equality, and bits set from either end of empty hashes."""
    rows = r8(spark, sf_dir).select("vec_id", rs.average_hash(F.col("p")).alias("h"))
    marked = hs.set_bit(hs.set_bit_reverse(hs.new_binary(30), 0), 25)
    return rows.select("vec_id", hs.hash_to_string(F.col("h")).alias("text"), hs.hash_length(F.col("h")).alias("length"), hs.value_at(F.col("h"), 2).alias("third"), hs.hash_equal(F.col("h"), F.col("h")).alias("same"), marked.alias("marked"))


# Sketches: words are pixels above 160, counted by their value over 32


def _histogram(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", F.transform("p", lambda v: F.when(v > 160, F.floor(v / 32)).otherwise(0).cast("int")).alias("hist"))


_HIST = R8 + ", h AS (SELECT vec_id, list_transform(p, lambda v: CASE WHEN v > 160 THEN v // 32 ELSE 0 END) AS hist FROM r)"
_FACTORS = "[" + ", ".join(f"[{a}::HUGEINT, {c}::HUGEINT]" for a, c in ds.minhash_factors(16)) + "]"
_SIGNS = "[" + ", ".join("[" + ", ".join(str(int(v)) for v in row) + "]" for row in ds.simhash_signs(64, 32).T) + "]"


@_query(
    "minhash_sig",
    f"WITH {_HIST}, w AS (SELECT vec_id, list_filter(range(64), lambda k: hist[CAST(k + 1 AS INTEGER)] > 0) AS words FROM h) SELECT vec_id, list_transform({_FACTORS}, lambda f: CASE WHEN len(words) = 0 THEN 0.0 "
    f"ELSE least(list_min(list_transform(words, lambda w: (f[1] * w + f[2]) % {ds.MINHASH_PRIME})), {ds.MINHASH_PRIME - 1})::DOUBLE END) AS signature FROM w",
)
def minhash_sig(spark, sf_dir):
    return _histogram(spark, sf_dir).select("vec_id", rs.minhash(F.col("hist"), 64, 16).alias("signature"))


@_query(
    "simhash_sig",
    f"WITH {_HIST}, v AS (SELECT vec_id, list_transform({_SIGNS}, lambda s: list_sum(list_transform(range(64), lambda k: hist[CAST(k + 1 AS INTEGER)] * s[CAST(k + 1 AS INTEGER)])) > 0) AS bits FROM h) SELECT vec_id, {_bytes('bits')} AS hash FROM v",
)
def simhash_sig(spark, sf_dir):
    return _histogram(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.simhash(F.col("hist"), 64, 32)).alias("hash"))


# Joins

_WORDS = R8 + ", w AS (SELECT vec_id, label, list_transform(p, lambda v: (v > round(list_avg(p)))::INTEGER) AS b FROM r)"


@_query(
    "sim_join",
    f"""WITH {R8}, w AS (SELECT vec_id, list_transform({_block_sql(2, 2)}, lambda v: (v >= list_avg(p))::INTEGER) AS b FROM r),
q AS (SELECT x.vec_id AS id_a, y.vec_id AS id_b, list_sum(list_transform(range(16), lambda k: abs(x.b[CAST(k + 1 AS INTEGER)] - y.b[CAST(k + 1 AS INTEGER)])))::DOUBLE AS distance FROM w x JOIN w y ON x.vec_id < y.vec_id) SELECT * FROM q WHERE distance <= 2""",
)
def sim_join(spark, sf_dir):
    rows = r8(spark, sf_dir).select("vec_id", rs.block_mean_hash(F.col("p"), 8, 8, 2, 2).alias("h"))
    return sim.hamming_join(rows, "vec_id", "h", 2, 2, expand=True)


@_query(
    "sim_join_classes",
    f"""WITH {R8}, w AS (SELECT vec_id, list_transform({_block_sql(2, 2)}, lambda v: (v >= list_avg(p))::INTEGER) AS b FROM r), c AS (SELECT b, min(vec_id) AS id FROM w GROUP BY b),
q AS (SELECT x.id AS id_a, y.id AS id_b, list_sum(list_transform(range(16), lambda k: abs(x.b[CAST(k + 1 AS INTEGER)] - y.b[CAST(k + 1 AS INTEGER)])))::DOUBLE AS distance FROM c x JOIN c y ON x.id < y.id) SELECT * FROM q WHERE distance <= 2""",
)
def sim_join_classes(spark, sf_dir):
    rows = r8(spark, sf_dir).select("vec_id", rs.block_mean_hash(F.col("p"), 8, 8, 2, 2).alias("h"))
    return sim.hamming_join(rows, "vec_id", "h", 2, 2)


@_query(
    "knn",
    f"""WITH {_WORDS}, q AS (SELECT x.vec_id AS id, y.vec_id AS neighbour, list_sum(list_transform(range(64), lambda k: abs(x.b[CAST(k + 1 AS INTEGER)] - y.b[CAST(k + 1 AS INTEGER)])))::DOUBLE AS distance
FROM w x JOIN w y ON x.label = y.label AND x.vec_id <> y.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour)::INTEGER AS rank FROM q) SELECT * FROM k WHERE rank <= 3""",
)
def knn(spark, sf_dir):
    rows = hh.spread(r8(spark, sf_dir)).select("vec_id", "label", metrics.packed(rs.average_hash(F.col("p"))).alias("h"))
    return sim.nearest(rows, "vec_id", "h", 3, metrics.hamming_packed, "label")


@_query("equal_groups", f"WITH {R8}, b AS (SELECT vec_id, list_transform({_block_sql(4, 4)}, lambda v: v >= list_avg(p)) AS bits FROM r) SELECT {_bytes('bits')} AS hash, min(vec_id) AS first_id, count(*) AS size FROM b GROUP BY 1")
def equal_groups(spark, sf_dir):
    rows = r8(spark, sf_dir).select("vec_id", hs.hash_to_string(rs.block_mean_hash(F.col("p"), 8, 8, 4, 4)).alias("hash"))
    return sim.equal_groups(rows, "vec_id", "hash")


# Projections


@_query("normalize", f"WITH {R8} SELECT vec_id, list_transform(p, lambda v: round((v - list_min(p))::DOUBLE / (list_max(p) - list_min(p)), 9)) AS values FROM r")
def normalize(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", F.transform(rs.normalize(F.col("p")), lambda v: F.round(v, 9)).alias("values"))


@_query(
    "z_score",
    f"WITH {R8}, m AS (SELECT vec_id, list_transform(p, lambda v: v / 255e0 - list_avg(p) / 255e0) AS c FROM r), s AS (SELECT vec_id, c, sqrt(list_sum(list_transform(c, lambda v: v * v)) / 64) AS s FROM m) SELECT vec_id, list_transform(c, lambda v: round(v / s, 6) + 0e0) AS values FROM s",
)
def z_score(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", _rounded(rs.z_score(F.col("p"))).alias("values"))


@_query("unit_vector", f"WITH {R8} SELECT vec_id, list_transform(p, lambda v: round(v / sqrt(list_sum(list_transform(p, lambda u: (u * u)::DOUBLE))), 9)) AS values FROM r")
def unit_vector(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", F.transform(rs.unit(F.col("p")), lambda v: F.round(v, 9)).alias("values"))


@_query("saturate", "SELECT vec_id, list_transform(embedding, lambda e: greatest(0, least(255, round(e::DOUBLE * 100 + 100)))::INTEGER) AS pixels FROM embeddings")
def saturate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", rs.saturate(F.transform("embedding", lambda e: e.cast("double") * 100 + 100)).alias("pixels"))


@_query("top_left", f"WITH {R8} SELECT vec_id, list_concat(p[1:3], p[9:11]) AS pixels FROM r")
def top_left(spark, sf_dir):
    return r8(spark, sf_dir).select("vec_id", rs.top_left(F.col("p"), 8, 3, 2).alias("pixels"))


@_query(
    "circular_run",
    f"WITH {R8}, f AS (SELECT vec_id, list_transform(p[1:16], lambda v: v >= 120) AS f FROM r) SELECT vec_id, "
    "coalesce(list_max(list_transform(range(16), lambda s: list_max(list_transform(range(1, 17), lambda n: CASE WHEN len(list_filter(range(n), lambda k: NOT f[CAST((s + k) % 16 + 1 AS INTEGER)])) = 0 THEN n ELSE 0 END)))), 0)::INTEGER AS run FROM f",
)
def circular_run(spark, sf_dir):
    flags = F.transform(F.slice("p", 1, 16), lambda v: v >= 120)
    return r8(spark, sf_dir).select("vec_id", rs.longest_circular_run(flags, 16).alias("run"))


# From rows to rasters: a user's events by day of the month and hour


@_query(
    "rasterize",
    """WITH c AS (SELECT user_id, day(ts) - 1 AS y, hour(ts) AS x, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT user_id, y * 24 + x AS k, least(255, n) AS v FROM c WHERE y < 30)
SELECT user_id, sum(v)::DOUBLE AS m00, sum(v * (k % 24))::DOUBLE AS m10, sum(v * (k // 24))::DOUBLE AS m01, max(v)::INTEGER AS top FROM k GROUP BY user_id""",
)
def rasterize(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x"), F.lit(1).alias("one"))
    images = rz.rasterize(rows, "user_id", "y", "x", "one", 24, 30)
    m = rs.raw_moments(F.col("raster.pixels"), 24)
    return images.select("user_id", m.alias("m"), F.array_max("raster.pixels").alias("top")).select("user_id", "m.m00", "m.m10", "m.m01", "top")


@_query("pixel_table", f"WITH {R8} SELECT vec_id, (k // 8)::INTEGER AS y, (k % 8)::INTEGER AS x, p[CAST(k + 1 AS INTEGER)] AS v FROM r, range(64) t(k)")
def pixel_table(spark, sf_dir):
    return rz.pixels(gray_images(spark, sf_dir), "vec_id", "raster")


# Descriptors of 8 x 8 images that SQL can say: places and weights are written out

_AT = "p[CAST(k + 1 AS INTEGER)]"


def _list(values) -> str:
    return "[" + ", ".join(str(int(v)) for v in values) + "]"


def _turned_sql() -> str:
    means = []
    for d in range(24):
        place, inside = ds._turned(8, 8, 15 * d) if d else (range(64), [True] * 64)
        flat = [int(a) + 1 if b else 0 for a, b in zip(list(getattr(place, "ravel", lambda: place)()), list(getattr(inside, "ravel", lambda: inside)()), strict=True)]
        means.append(_list(flat))
    turned = f"list_transform([{', '.join(means)}], lambda t: list_transform(t, lambda i: CASE WHEN i = 0 THEN 0 ELSE p[i] END))"
    block = "(q[CAST((b // 4) * 16 + (b % 4) * 2 + 1 AS INTEGER)] + q[CAST((b // 4) * 16 + (b % 4) * 2 + 2 AS INTEGER)] + q[CAST((b // 4) * 16 + (b % 4) * 2 + 9 AS INTEGER)] + q[CAST((b // 4) * 16 + (b % 4) * 2 + 10 AS INTEGER)]) / 4.0"
    return f"t AS (SELECT vec_id, {turned} AS t FROM r), b AS (SELECT vec_id, flatten(list_transform(t, lambda q: list_transform(range(16), lambda b: {block} >= list_avg(q)))) AS bits FROM t)"


@_query("block_mean_turned", _packed(R8 + ", " + _turned_sql(), "b"))
def block_mean_turned(spark, sf_dir):
    hasher = hh.BlockMean(width=8, height=8, block_width=2, block_height=2, method=BlockMethod.ROTATION)
    return gray_images(spark, sf_dir).select("vec_id", hs.hash_to_string(hasher.hash("raster")).alias("hash"))


def _zernike_sql() -> str:
    basis = ds._zernike_basis(8, 8, 4)
    sums = lambda part: f"list_transform([{', '.join(_numbers(c) for c in part.T)}], lambda w: list_sum(list_transform(range(64), lambda k: {_AT} / 255e0 * w[CAST(k + 1 AS INTEGER)])))"
    n = _numbers([o[0] + 1 for o in ds.zernike_orders(4)])
    return (
        f"WITH {R8}, s AS (SELECT vec_id, {sums(basis.real)} AS re, {sums(basis.imag)} AS im FROM r), "
        f"a AS (SELECT vec_id, list_transform(range(len(re)), lambda i: sqrt(re[CAST(i + 1 AS INTEGER)] ** 2 + im[CAST(i + 1 AS INTEGER)] ** 2) * {n}[CAST(i + 1 AS INTEGER)] / pi()) AS a FROM s) "
        "SELECT vec_id, list_transform(a[2:], lambda v: round(v / a[1], 9) + 0e0) AS hash FROM a"
    )


@_query("zernike_small", _zernike_sql())
def zernike_small(spark, sf_dir):
    hasher = hh.Zernike(width=8, height=8, degree=4)
    return gray_images(spark, sf_dir).select("vec_id", _rounded(hasher.hash("raster"), 9).alias("hash"))


_BLUR3 = im.blur_taps(0, 1.0).tolist()


def _spread(n: int) -> list[list[tuple[int, int]]]:
    """For each place of a line, (place, weight) of the blur's neighbours."""
    out = []
    for x in range(n):
        near = [(x, _BLUR3[3])]
        for i in (1, 2, 3):
            near += [(x - i if x - i >= 0 else i, _BLUR3[3 - i]), (x + i if x + i < n else n - 1 - i, _BLUR3[3 + i])]
        out.append(near)
    return out


def _blurred_sql() -> str:
    lines = _spread(8)
    table = [[(a * 8 + b + 1, v * w) for a, v in lines[y] for b, w in lines[x]] for y in range(8) for x in range(8)]
    places = "[" + ", ".join(f"[{_list(i for i, _ in row)}, {_list(w for _, w in row)}]" for row in table) + "]"
    return f"u AS (SELECT vec_id, list_transform({places}, lambda t: (list_sum(list_transform(range(49), lambda k: p[t[1][CAST(k + 1 AS INTEGER)]] * t[2][CAST(k + 1 AS INTEGER)]))::BIGINT + 32768) >> 16) AS p FROM r)"


_RINGS = 6
_RING6 = "[" + ", ".join(_list(i + 1 for i in range(64) if ds._ring_of(8, 8, _RINGS)[i] == g) for g in range(_RINGS)) + "]"


@_query(
    "rash_small",
    f"WITH {R8}, {_blurred_sql()}, m AS (SELECT vec_id, list_transform({_RING6}, lambda g: coalesce(list_avg(list_transform(g, lambda i: p[i])), 0)) AS m FROM u), "
    f"c AS (SELECT vec_id, list_transform([{', '.join(_numbers(r) for r in im.dct_matrix(_RINGS)[1:])}], lambda w: list_sum(list_transform(range({_RINGS}), lambda k: m[CAST(k + 1 AS INTEGER)] * w[CAST(k + 1 AS INTEGER)]))) AS c FROM m), "
    f"b AS (SELECT vec_id, list_transform(c, lambda v: v > list_sort(c)[3]) AS bits FROM c) SELECT vec_id, {_bytes('bits')} AS hash FROM b",
)
def rash_small(spark, sf_dir):
    return gray_images(spark, sf_dir).select("vec_id", hs.hash_to_string(hh.RASH(width=8, height=8, rings=_RINGS).hash("raster")).alias("hash"))


def _layout_sql() -> str:
    c = im.dct_matrix(8)
    r, g, b = _AT, "p[CAST(64 - k AS INTEGER)]", f"(255 - {_AT})"
    planes = [
        f"(19595 * {r} + 38470 * {g} + 7471 * {b} + 32768) >> 16",
        f"greatest(0, least(255, floor((-11056 * {r} - 21712 * {g} + 32768 * {b} + 8421376) / 65536.0)))",
        f"greatest(0, least(255, floor((32768 * {r} - 27440 * {g} - 5328 * {b} + 8421376) / 65536.0)))",
    ]
    ctes, parts = [], []
    for n, (plane, keep) in enumerate(zip(planes, ds.CLD_COEFFICIENTS, strict=True)):
        basis = "[" + ", ".join(_numbers([c[z // 8][y] * c[z % 8][x] for y in range(8) for x in range(8)]) for z in ds.ZIGZAG[:keep]) + "]"
        ctes.append(f"y{n} AS (SELECT vec_id, list_transform({basis}, lambda w: list_sum(list_transform(range(64), lambda k: ({plane})::DOUBLE * w[CAST(k + 1 AS INTEGER)]))) AS c{n} FROM r)")
        parts.append(f"[greatest(0, least(63, round(c{n}[1]::FLOAT::DOUBLE / 8 * 63 / 255)))::INTEGER] || list_transform(c{n}[2:], lambda v: greatest(0, least(31, round(v::FLOAT::DOUBLE / 16) + 16))::INTEGER)")
    return f"WITH {R8}, {', '.join(ctes)} SELECT vec_id, {' || '.join(parts)} AS hash FROM y0 JOIN y1 USING (vec_id) JOIN y2 USING (vec_id)"


@_query("cld_small", _layout_sql())
def cld_small(spark, sf_dir):
    return colour_images(spark, sf_dir).select("vec_id", hh.CLD(width=8, height=8).hash("raster").alias("hash"))


@_query(
    "hog_cells",
    SQL["hog_gradients"].split("SELECT vec_id, list_transform(d, lambda v: round(sqrt")[0]
    + """, m AS (SELECT vec_id, list_transform(d, lambda v: [sqrt((v[1] * v[1] + v[2] * v[2])::DOUBLE), CASE WHEN v[2] = 0 THEN 0e0 WHEN atan2(v[2], v[1]) < 0 THEN atan2(v[2], v[1]) * 180 / pi() + 180 ELSE atan2(v[2], v[1]) * 180 / pi() END]) AS m FROM g),
h AS (SELECT vec_id, list_transform(range(4), lambda c: list_transform(range(9), lambda b: list_sum(list_concat([0e0], list_transform(list_filter(range(64), lambda k: (k // 32) * 2 + (k % 8) // 4 = c AND least(8, floor(m[CAST(k + 1 AS INTEGER)][2] / 20)) = b), lambda k: m[CAST(k + 1 AS INTEGER)][1]))))) AS h FROM m)
SELECT vec_id, flatten(list_transform(h, lambda c: list_transform(c, lambda v: CASE WHEN list_max(c) > 0 THEN floor(v * 255 / list_max(c))::INTEGER ELSE 0 END))) AS hash FROM h""",
)
def hog_cells(spark, sf_dir):
    return gray_images(spark, sf_dir).select("vec_id", hh.HOG(width=8, height=8, cell=4).hash("raster").alias("hash"))


# Hashers over images, with SQL where it can say the kernel in reason; tests hold all of them against plain loops


def _hasher_query(name: str, hasher: hh.Hasher, colour: bool = False):
    def run(spark, sf_dir):
        images = (colour_images if colour else gray_images)(spark, sf_dir)
        out = hasher.hash("raster")
        return images.select("vec_id", (F.transform(out, lambda v: F.round(v, 9)) if hasher.kind == Kind.FLOAT64 else out).alias("hash"))

    _query(name, image_sql.SQL.get(name))(run)


for _name, _hasher, _colour in [
    ("average_image", hh.Average(), True),
    ("median_image", hh.Median(), True),
    ("difference_image", hh.Difference(), True),
    ("phash_image", hh.PHash(), True),
    ("whash_image", hh.WHash(), True),
    ("block_mean_image", hh.BlockMean(), True),
    ("block_mean_rotation", hh.BlockMean(width=64, height=64, method=BlockMethod.ROTATION), False),
    ("block_mean_rotation_overlap", hh.BlockMean(width=64, height=64, method=BlockMethod.ROTATION_OVERLAP), False),
    ("marr_hildreth", hh.MarrHildreth(), False),
    ("pdq", hh.PDQ(), False),
    ("rash", hh.RASH(), False),
    ("radial_variance", hh.RadialVariance(), False),
    ("color_moment", hh.ColorMoment(width=64, height=64), True),
    ("cld_desc", hh.CLD(), True),
    ("lbp_image", hh.LBP(), False),
    ("hog_hist", hh.HOG(), False),
    ("gist", hh.GIST(), False),
    ("zernike", hh.Zernike(), False),
    ("bovw_hist", hh.BoVW(width=64, height=64), False),
    ("bovw_minhash", hh.BoVW(width=64, height=64, storage=Storage.MINHASH), False),
    ("bovw_simhash", hh.BoVW(width=64, height=64, feature=Feature.AKAZE, storage=Storage.SIMHASH), False),
]:
    _hasher_query(_name, _hasher, _colour)


@_query("jarosz", image_sql.SQL["jarosz"])
def jarosz(spark, sf_dir):
    out = kc.vector_column("raster", lambda x: im.jarosz(im.to_gray(x), 2, 2).reshape(len(x), -1))
    return gray_images(spark, sf_dir).select("vec_id", _rounded(out, 3).alias("pixels"))


@_query("log_filter", image_sql.SQL["log_filter"])
def log_filter(spark, sf_dir):
    kernel = ds.marr_hildreth_kernel(1.0, 1.0)
    out = kc.vector_column("raster", lambda x: im.correlate(im.to_gray(x), kernel).reshape(len(x), -1))
    return gray_images(spark, sf_dir).select("vec_id", _rounded(out, 3).alias("pixels"))


@_query("radial_scaled", image_sql.SQL["radial_scaled"])
def radial_scaled(spark, sf_dir):
    """radial_variance before it is cut to bytes, to six digits: the byte of the largest coefficient hangs on the last
    digit of a sum, so that SQL can't be held to it."""
    out = kc.vector_column("raster", lambda x: ds.radial_scaled(im.gaussian_blur(im.to_gray(x), 0, 1.0), 180))
    return gray_images(spark, sf_dir).select("vec_id", _rounded(out).alias("hash"))


def _keypoints_query(feature: Feature):
    def run(spark, sf_dir):
        return kc.keypoints(gray_images(spark, sf_dir), "vec_id", "raster", feature, 64, 50)

    return run


_query("orb_keypoints", image_sql.SQL["orb_keypoints"])(_keypoints_query(Feature.ORB))
_query("akaze_keypoints", image_sql.SQL["akaze_keypoints"])(_keypoints_query(Feature.AKAZE))


def nearest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: each image's nearest other image of its label by average hash."""
    return knn(spark, sf_dir).where("rank = 1").select("id", "neighbour", "distance")

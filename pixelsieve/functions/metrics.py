"""Metrics between hash columns, as JVM expressions (but for PCC).

Hashes are arrays: bytes of a binary hash (0 to 255), whole numbers, or doubles. Hamming, L1, L2, cosine and
chi-square compare up to the shorter length; PCC and the Jaccard distance of vectors need equal lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelsieve import errors as err
from pixelsieve.types import Kind

Metric = Callable[[Column, Column], Column]


def _fail(error: type[Exception]) -> Column:
    return F.raise_error(F.lit(err.MESSAGES[error])).cast("double")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _paired(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f over the positions that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def _num(x: Column) -> Column:
    return x.cast("double")


def same_length(a: Column, b: Column, then: Column) -> Column:
    return F.when(F.size(a) == F.size(b), then).otherwise(F.when(a.isNotNull() & b.isNotNull(), _fail(err.HashLengthMismatch)))


def bits(x: Column) -> Column:
    return F.bit_count(x.cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ."""
    return _total(_paired(a, b, lambda x, y: bits(x.cast("int").bitwiseXOR(y.cast("int"))).cast("double")))


def packed(a: Column) -> Column:
    """A binary hash as longs of eight bytes, first byte lowest; the last one is filled up with zeros."""
    n = F.ceil(F.size(a) / 8).cast("int")
    byte = lambda k: F.coalesce(F.try_element_at(a, (k + 1).cast("int")), F.lit(0)).cast("long")

    def word(i: Column) -> Column:
        out = byte(i * 8)
        for j in range(1, 8):
            out = out.bitwiseOR(F.shiftleft(byte(i * 8 + j), 8 * j))
        return out

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


def hamming_packed(a: Column, b: Column) -> Column:
    """As hamming, of packed hashes of equal length: eight bytes a step."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


def weighted_hamming(a: Column, b: Column, weights) -> Column:
    """Bits that differ, times the weight of their byte; there must be a weight for each byte compared."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    n = F.least(F.size(a), F.size(b))
    differ = _paired(a, b, lambda x, y: bits(x.cast("int").bitwiseXOR(y.cast("int"))).cast("double"))
    return F.when(n == len(list(weights)), _total(F.zip_with(differ, w, lambda d, v: d * v))).when(a.isNotNull() & b.isNotNull(), _fail(err.WeightLengthMismatch))


def l1(a: Column, b: Column) -> Column:
    return _total(_paired(a, b, lambda x, y: F.abs(_num(x) - _num(y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(_paired(a, b, lambda x, y: (_num(x) - _num(y)) * (_num(x) - _num(y)))))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine; 0 where either vector is zero."""
    dot = _total(_paired(a, b, lambda x, y: _num(x) * _num(y)))
    aa, bb = _total(_paired(a, b, lambda x, y: _num(x) * _num(x))), _total(_paired(a, b, lambda x, y: _num(y) * _num(y)))
    return F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(1 - dot / (F.sqrt(aa) * F.sqrt(bb)))


def chi_square(a: Column, b: Column) -> Column:
    """Squared differences over sums; positions whose sum is 0 don't count."""

    def term(x: Column, y: Column) -> Column:
        s = _num(x) + _num(y)
        return F.when(s == 0, 0.0).otherwise((_num(x) - _num(y)) * (_num(x) - _num(y)) / s)

    return _total(_paired(a, b, term))


#: Pairs whose shifts are looked at together.
PCC_ROWS = 512


def _peaks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest correlation of each row of a with any circular shift of its row of b."""
    n = a.shape[1]
    shifts = (np.arange(n)[None, :] - np.arange(n)[:, None]) % n
    sides, spreads = [], []
    for x in (a.astype(np.float32), b.astype(np.float32)):
        wide = x.astype(np.float64)
        mean = wide.mean(axis=1, keepdims=True)
        spreads.append(np.sqrt(np.maximum((wide * wide).mean(axis=1) - mean[:, 0] ** 2, 0)))
        sides.append((x - mean.astype(np.float32)).astype(np.float64))
    best = np.empty(len(a))
    for lo in range(0, len(a), PCC_ROWS):
        rows = slice(lo, lo + PCC_ROWS)
        best[rows] = np.einsum("pk,prk->pr", sides[0][rows], sides[1][rows][:, shifts]).max(axis=1)
    return np.maximum(best / n / (spreads[0] * spreads[1] + 1e-20), 5e-324)


def _pcc(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        out = np.full(len(a), np.nan)
        size = np.array([len(x) if x is not None and y is not None and len(x) == len(y) else -1 for x, y in zip(a, b, strict=True)], np.int64)
        out[size == 0] = 5e-324
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            out[at] = _peaks(np.stack([a.iloc[k] for k in at]), np.stack([b.iloc[k] for k in at]))
        yield pd.Series(out)


def pcc(a: Column, b: Column) -> Column:
    """The largest correlation of a with any circular shift of b: larger is nearer. Centred values are single
    precision; the result is never below the smallest positive double. Of n values n * n products a pair: in Arrow
    batches."""
    run = F.pandas_udf(_pcc, "double")
    value = run(a.cast("array<double>"), b.cast("array<double>"))
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), _fail(err.NotSameLength))


def _correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As pcc, of each row of a with each of b: a product of matrices for each shift."""
    n = a.shape[1]
    if not n:
        return np.full((len(a), len(b)), 5e-324)
    sides, spreads = [], []
    for x in (a.astype(np.float32), b.astype(np.float32)):
        wide = x.astype(np.float64)
        mean = wide.mean(axis=1, keepdims=True)
        spreads.append(np.sqrt(np.maximum((wide * wide).mean(axis=1) - mean[:, 0] ** 2, 0)))
        sides.append((x - mean.astype(np.float32)).astype(np.float64))
    best = sides[0] @ sides[1].T
    product = np.empty_like(best)
    for shift in range(1, n):
        np.maximum(best, np.matmul(sides[0], np.roll(sides[1], shift, axis=1).T, out=product), out=best)
    return np.maximum(best / n / (spreads[0][:, None] * spreads[1][None, :] + 1e-20), 5e-324)


def _cut(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(a.shape[1], b.shape[1])
    return a[:, :n], b[:, :n]


def _whole(*sides: np.ndarray) -> bool:
    """Whether sums of products are exact in doubles, in any order."""
    return all((np.abs(x) < 1 << 20).all() and (x == np.rint(x)).all() and x.shape[1] < 1 << 10 for x in sides)


def _summed(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Terms of each row of a with each of b, added up in the order of places, as the JVM does."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += term(a[:, k, None], b[None, :, k])
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _cut(a, b)
    dot = a @ b.T if _whole(a, b) else _summed(a, b, np.multiply)
    aa, bb = (_summed(x * x, np.ones((1, x.shape[1])), np.multiply)[:, 0] for x in (a, b))
    some = (aa != 0)[:, None] & (bb != 0)[None, :]
    return np.where(some, 1 - dot / np.where(some, np.sqrt(aa)[:, None] * np.sqrt(bb)[None, :], 1.0), 0.0)


def _chi_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def term(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s, d = x + y, x - y
        d *= d
        s[s == 0] = np.inf
        d /= s
        return d

    return _summed(*_cut(a, b), term)


def _l2s(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _cut(a, b)
    if _whole(a, b):
        return np.sqrt((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))
    return np.sqrt(_summed(a, b, lambda x, y: (x - y) * (x - y)))


#: The same values as the columns of these metrics, from two matrices of vectors: each row of one with each of the
#: other, for pairs by the block. PCC needs equal lengths.
MATRICES: dict[Metric, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {pcc: _correlations, cosine: _cosines, chi_square: _chi_squares, l2: _l2s}


def jaccard(a: Column, b: Column, kind: Kind = Kind.BINARY) -> Column:
    """Binary: 1 - common bits / bits of either, bytes beyond the shorter hash count as other bits. Vectors: the
    share of positions that differ. 0 for empty ones."""
    if Kind(kind) == Kind.BINARY:
        zero = lambda x: F.coalesce(x.cast("int"), F.lit(0))
        both = _total(F.zip_with(a, b, lambda x, y: bits(zero(x).bitwiseAND(zero(y))).cast("double")))
        either = _total(F.zip_with(a, b, lambda x, y: bits(zero(x).bitwiseOR(zero(y))).cast("double")))
        return F.when(either == 0, F.lit(0.0)).otherwise(1 - both / either)
    same = _total(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)))
    equal = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(1 - same / F.size(a))
    return F.when(F.size(a) == F.size(b), equal).when(a.isNotNull() & b.isNotNull(), _fail(err.HashLengthMismatch))


#: Metrics by name; all but weighted Hamming and the Jaccard distance of vectors need no more than two columns.
METRICS: dict[str, Metric] = {"hamming": hamming, "l1": l1, "l2": l2, "cosine": cosine, "chi_square": chi_square, "pcc": pcc, "jaccard": jaccard}


def compared_by(kind_a: Kind, kind_b: Kind, metric: Metric | None = None) -> Metric:
    """The metric by which compare() goes: bits by Hamming, others by L2, or the given one."""
    if (Kind(kind_a) == Kind.BINARY) != (Kind(kind_b) == Kind.BINARY):
        raise err.IncompatibleHash(err.MESSAGES[err.IncompatibleHash])
    return metric or (hamming if Kind(kind_a) == Kind.BINARY else l2)


def compare(a: Column, kind_a: Kind, b: Column, kind_b: Kind, metric: Metric | None = None) -> Column:
    """Any two hashes: bits by Hamming, others by L2, or by the given metric. Kinds are known when the plan is
    built; bits compare with bits only."""
    return compared_by(kind_a, kind_b, metric)(a, b)


def equal_distance(a: Column, b: Column) -> Column:
    """Distances are equal within 1e-12."""
    return F.abs(a - b) <= 1e-12

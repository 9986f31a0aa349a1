"""Scalar functions of hash columns (arrays of bytes or doubles), as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelsieve import errors as err
from pixelsieve.types import Kind


def new_binary(bits: Column | int) -> Column:
    """So many zero bits, in whole bytes."""
    n = F.lit(bits) if isinstance(bits, int) else bits
    return F.array_repeat(F.lit(0), F.ceil(n / 8).cast("int"))


def _set(h: Column, position: Column | int, low_first: bool) -> Column:
    p = (F.lit(position) if isinstance(position, int) else position).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k if low_first else 128 >> k) for k in range(8)]), p % 8 + 1)
    changed = F.transform(h, lambda b, i: F.when(i == F.floor(p / 8), b.cast("int").bitwiseOR(mask)).otherwise(b.cast("int")))
    inside = (p >= 0) & (F.floor(p / 8) < F.size(h))
    return F.when(inside, changed).otherwise(F.raise_error(F.lit(err.MESSAGES[err.OutOfBounds])).cast("array<int>"))


def set_bit(h: Column, position: Column | int) -> Column:
    """With the bit set, counted from each byte's lowest; only whole bytes are checked for their bounds."""
    return _set(h, position, True)


def set_bit_reverse(h: Column, position: Column | int) -> Column:
    """With the bit set, counted from each byte's highest."""
    return _set(h, position, False)


def hash_length(h: Column) -> Column:
    return F.size(h)


def value_at(h: Column, index: Column | int) -> Column:
    """A byte or value as a double; null beyond the end."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.try_element_at(h, i.cast("int") + 1).cast("double")


def hash_equal(a: Column, b: Column, kind: Kind = Kind.BINARY) -> Column:
    """Doubles are equal within 2.22e-16, and not-a-number equals itself."""
    if Kind(kind) != Kind.FLOAT64:
        return a == b
    eps = 2.220446049250313e-16
    near = F.forall(F.zip_with(a, b, lambda x, y: (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= eps)), lambda t: t)
    return (F.size(a) == F.size(b)) & F.when(F.size(a) == F.size(b), near).otherwise(F.lit(False))


def hash_to_string(h: Column) -> Column:
    """``[1 2 3]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(h, lambda x: x.cast("string")), " "), F.lit("]"))


def hash_to_hex(h: Column) -> Column:
    return F.lower(F.array_join(F.transform(h, lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), ""))


def pack(flags: Column, low_first: bool = True) -> Column:
    """Booleans in bytes; spare bits are 0."""

    def byte(b: Column) -> Column:
        out = F.lit(0)
        for j in range(8):
            out = out + F.when(F.coalesce(F.try_element_at(flags, (b * 8 + j + 1).cast("int")), F.lit(False)), 1 << j if low_first else 128 >> j).otherwise(0)
        return out

    n = F.ceil(F.size(flags) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<int>"))

"""Kinds of hashes and the options that are enumerations."""

from __future__ import annotations

import enum


class Kind(enum.StrEnum):
    """How a hash is stored: bits in bytes, whole numbers 0 to 255, or doubles. Each is a column of its own type."""

    BINARY = "binary"
    UINT8 = "uint8"
    FLOAT64 = "float64"

    @property
    def spark_type(self) -> str:
        return {"binary": "array<int>", "uint8": "array<int>", "float64": "array<double>"}[self.value]


class Interpolation(enum.IntEnum):
    NEAREST = 0
    BILINEAR = 1
    BICUBIC = 2
    MITCHELL_NETRAVALI = 3
    LANCZOS2 = 4
    LANCZOS3 = 5
    BILINEAR_EXACT = 6

    @property
    def label(self) -> str:
        return "".join(p.capitalize() for p in self.name.split("_"))


def interpolation_label(value: int) -> str:
    """The name of an interpolation, `Unknown` for numbers that are none."""
    return Interpolation(value).label if value in Interpolation._value2member_map_ else "Unknown"


class BlockMethod(enum.IntEnum):
    DIRECT = 0
    OVERLAP = 1
    ROTATION = 2
    ROTATION_OVERLAP = 3


class Feature(enum.IntEnum):
    ORB = 1
    AKAZE = 2


class Storage(enum.IntEnum):
    HISTOGRAM = 1
    MINHASH = 2
    SIMHASH = 3

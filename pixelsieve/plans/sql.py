"""Pieces of SQL (DuckDB) that the queries' texts share."""

from __future__ import annotations

import numpy as np

R8 = """r AS (SELECT vec_id, label, list_transform(embedding,
  lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INTEGER)) AS p FROM embeddings)"""


def numbers(values) -> str:
    """A list of doubles (without an exponent they would be decimals)."""
    return "[" + ", ".join(f"{float(v):.17e}" for v in values) + "]"


def table(rows, name: str) -> str:
    """Rows of whole numbers and doubles as a table; `name` has its columns too."""
    said = lambda v: str(int(v)) if isinstance(v, (int, np.integer)) else f"{float(v):.17e}"
    return f"(VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) {name}"


def entries(matrix: np.ndarray) -> list[tuple]:
    """Row, column and value of a matrix where it isn't 0."""
    return [(int(i), int(j), matrix[i, j]) for i, j in zip(*np.nonzero(matrix), strict=True)]

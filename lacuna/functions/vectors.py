"""SQL text for short vectors.

Factor vectors of a known rank are handled as unrolled arithmetic, because that stays inside
whole-stage code generation; higher-order functions are used only where the rank is unknown.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float) -> str:
    """A double literal."""
    return f"({float(x)!r}D)"


def columns(prefix: str, rank: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(rank)]


def dot(left: Sequence[str], right: Sequence[str]) -> str:
    return " + ".join(f"{a} * {b}" for a, b in zip(left, right, strict=True))


def combine(names: Sequence[str], weights: Sequence[float]) -> str:
    """Linear combination of columns with fixed weights; zero weights are left out."""
    terms = [name if w == 1.0 else f"{name} * {number(w)}" for name, w in zip(names, weights, strict=True) if w]
    return " + ".join(terms) if terms else "0D"


def rotated(names: Sequence[str], matrix: np.ndarray, out: str) -> list[str]:
    """The row vector ``names`` times a small ``matrix``, as select expressions ``out0, out1, ...``."""
    return [f"{combine(names, matrix[:, k])} AS {out}{k}" for k in range(matrix.shape[1])]


def gram_sql(names: Sequence[str]) -> str:
    """Upper triangle of the Gram matrix of a table, row by row, as one array aggregate."""
    return "array(" + ", ".join(
        f"sum({a} * {b})" for i, a in enumerate(names) for b in names[i:]) + ")"


def cross_sql(left: Sequence[str], right: Sequence[str]) -> str:
    """All products of two column lists, row by row, as one array aggregate."""
    return "array(" + ", ".join(f"sum({a} * {b})" for a in left for b in right) + ")"


def gram_matrix(flat: Sequence[float], rank: int) -> np.ndarray:
    out = np.zeros((rank, rank))
    upper = np.triu_indices(rank)
    out[upper] = [x or 0.0 for x in flat]
    return out + np.triu(out, 1).T


def cross_matrix(flat: Sequence[float], rows: int, cols: int) -> np.ndarray:
    return np.array([x or 0.0 for x in flat], dtype=float).reshape(rows, cols)


def unpack(name: str, prefix: str, rank: int) -> list[str]:
    """Array column to scalar columns."""
    return [f"{name}[{k}] AS {prefix}{k}" for k in range(rank)]


def pack(names: Sequence[str], alias: str) -> str:
    return f"array({', '.join(names)}) AS {alias}"


def array_dot(left: str, right: str, rank: int | None = None) -> Column:
    """Dot product of two array columns."""
    if rank is not None:
        return F.expr(dot([f"{left}[{k}]" for k in range(rank)], [f"{right}[{k}]" for k in range(rank)]))
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def array_scale(name: str, weights: Sequence[float]) -> Column:
    """Array column times fixed weights, element by element."""
    return F.expr("array(" + ", ".join(f"{name}[{k}] * {number(w)}" for k, w in enumerate(weights)) + ")")


def ratio_or_zero(num: str, den: str) -> Column:
    """Division in which 0/0 and x/0 count as 0."""
    return F.expr(f"coalesce(try_divide({num}, {den}), 0D)")

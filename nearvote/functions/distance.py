"""Squared distances in integers, unrolled over dimension columns so that they stay in generated code.

The expressions are built as SQL text: one parse instead of hundreds of calls from Python to the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _difference(a: str, b: str, j: int) -> str:
    return f"(cast({a}{j} as bigint) - cast({b}{j} as bigint))"


def l2_sql(a: str, b: str, dim: int) -> str:
    """Sum over the dimensions j of (aj - bj) squared, in bigint: 16-bit values can't overflow it."""
    return " + ".join(f"{_difference(a, b, j)} * {_difference(a, b, j)}" for j in range(dim))


def l2(a: str, b: str, dim: int) -> Column:
    """a and b: prefixes of the columns or fields, such as v for v0, v1 ..."""
    return F.expr(l2_sql(a, b, dim))


def l2_single(a: str, b: str, dim: int) -> Column:
    """The same of floats, in single precision, added up dimension by dimension."""
    return F.expr(" + ".join(f"({a}{j} - {b}{j}) * ({a}{j} - {b}{j})" for j in range(dim)))


def box_bound(q: str, low: str, high: str, dim: int) -> Column:
    """The squared distance from q to the box; no point inside the box is nearer."""
    side = lambda j: f"greatest({_difference(low, q, j)}, 0L, {_difference(q, high, j)})"
    return F.expr(" + ".join(f"{side(j)} * {side(j)}" for j in range(dim)))

"""Single-precision normalising and quantising, as column expressions.

Spark widens float arithmetic with untyped literals to double, so every literal and quotient is cast back to float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import SCALE


def f32(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def clamp01(x: Column) -> Column:
    return F.greatest(f32(0.0), F.least(f32(1.0), x))


def scaled(x: Column, most: float) -> Column:
    """x over most, as a product with the single-precision reciprocal."""
    return x.cast("float") * f32(1.0 / most)


def ratio(a: Column, b: Column) -> Column:
    """a / b in single precision, 0 where b isn't positive."""
    return F.when(b > 0, (a.cast("float") / F.nullif(b.cast("float"), f32(0.0))).cast("float")).otherwise(f32(0.0))


def quantise(x: Column) -> Column:
    """round(x * SCALE), halves away from zero, NaN and infinities to 0, saturated to 16 bits.

    Spark's round goes by way of BigDecimal; a half more in double precision, cut off, is as exact for floats of that size.
    """
    x = x.cast("float")
    finite = F.when(F.isnan(x) | (F.abs(x) == f32(float("inf"))), f32(0.0)).otherwise(x)
    y = F.greatest(f32(-32768.0), F.least(f32(32767.0), finite * f32(float(SCALE)))).cast("double")
    return (y + F.when(y < 0, F.lit(-0.5)).otherwise(F.lit(0.5))).cast("smallint")


def quantise_sql(x: str) -> str:
    """`quantise` as SQL text, for many columns at once."""
    f = f"cast({x} as float)"
    finite = f"CASE WHEN isnan({f}) OR abs({f}) = cast('Infinity' as float) THEN cast(0 as float) ELSE {f} END"
    y = f"cast(greatest(cast(-32768 as float), least(cast(32767 as float), ({finite}) * cast({SCALE} as float))) as double)"
    return f"cast({y} + CASE WHEN {y} < 0 THEN -0.5D ELSE 0.5D END as smallint)"


def dequantise(q: Column) -> Column:
    return q.cast("float") * f32(1.0 / SCALE)

"""Integer forms of feature vectors.

Arithmetic is single precision with rounding half to even, so results agree bit by bit with any engine
that follows the same rule. Values are clamped before they are narrowed; null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Q16_SCALE, Q8_SCALE = 10_000, 127


def single(value: float) -> Column:
    return F.lit(value).cast("float")


def _scaled(x: Column, scale: int, low: int, high: int) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(F.rint(x.cast("float") * single(scale)), F.lit(float(high))), F.lit(float(low))))


def q16(x: Column) -> Column:
    """One value as a multiple of 1/10000, 16 bits."""
    return _scaled(x, Q16_SCALE, -32768, 32767).cast("smallint")


def q8(x: Column) -> Column:
    """One value as a multiple of 1/127, 8 bits."""
    return _scaled(x, Q8_SCALE, -128, 127).cast("tinyint")


def q16_vector(v: Column) -> Column:
    return F.transform(v, q16)


def q8_vector(v: Column) -> Column:
    return F.transform(v, q8)


def from_q16(q: Column) -> Column:
    """The single-precision value that a query is scored with."""
    return q.cast("float") * single(1 / Q16_SCALE)

"""Distances between vectors, as expressions that stay inside generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def squared_distance(a: str | Column, b: str | Column, dims: int) -> Column:
    """The squared Euclidean distance of two integer arrays, exact in 64 bits; written out for each dimension."""
    d = [F.get(a, F.lit(i)).cast("long") - F.get(b, F.lit(i)).cast("long") for i in range(dims)]
    return reduce(add, [x * x for x in d])


def clamped(x: Column) -> Column:
    """Into [0, 1]; single precision."""
    return F.least(F.greatest(x.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))

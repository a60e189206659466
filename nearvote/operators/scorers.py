"""Strategies by name: each takes an index and queries and returns decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from nearvote.operators import ivf
from nearvote.operators.knn import decided, nearest, nearest_two_stage, voted

Scorer = Callable[[ivf.Index, DataFrame, ivf.Search], DataFrame]


def brute(index: ivf.Index, queries: DataFrame, how: ivf.Search) -> DataFrame:
    """All references, by 16-bit vectors."""
    return decided(voted(nearest(index.refs, queries), queries))


def two_stage(index: ivf.Index, queries: DataFrame, how: ivf.Search) -> DataFrame:
    """All references by 8-bit vectors, the nearest again by 16-bit ones."""
    return decided(voted(nearest_two_stage(index.refs, queries, how.candidates), queries))


def cells(index: ivf.Index, queries: DataFrame, how: ivf.Search) -> DataFrame:
    """The nearest cells."""
    return ivf.search(index, queries, how)


SCORERS: dict[str, Scorer] = {"brute": brute, "bruteq16": brute, "q16": brute, "q8": two_stage, "ivf": cells}


def scorer(name: str | None = None) -> Scorer:
    """The strategy of a name, letters in either case; none: brute."""
    found = SCORERS.get((name or "brute").lower())
    if found is None:
        raise ValueError(f"no scorer {name!r}; there are {', '.join(SCORERS)}")
    return found

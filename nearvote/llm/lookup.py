"""Chunks of rows with a dictionary of their own, whose entries are looked up in a table of the whole corpus.

What a row holds many of (words, ids, pairs of ids) is replaced by numbers of entries in its chunk's
dictionary. Only dictionaries are joined with the table, so an entry that all texts hold comes once a chunk;
no key is hot. Rows and what was found then meet by chunk, and a chunk is bounded by the bytes of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F


def chunk_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives. A table of them must be stored before it is read twice."""
    task = TaskContext.get()
    return ((task.partitionId() if task else 0) << 32 | n for n in count())


def packed(numbers: np.ndarray, entries: int) -> bytes:
    """Numbers of dictionary entries, low bytes first, then higher ones, compressed."""
    import zstandard

    wide = width(entries)
    planes = numbers.astype(wide).view(np.uint8).reshape(-1, wide.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(raw: bytes, entries: int) -> np.ndarray:
    import zstandard

    wide = width(entries)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide.itemsize, -1).T).view(wide).reshape(-1)


def width(entries: int) -> np.dtype:
    return np.dtype("<u2" if entries <= 1 << 16 else "<i4")


def by_chunk(rows: DataFrame, found: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The rows of each chunk with what was found for it."""
    found = found.withColumn("of", F.col("chunk") + 0).drop("chunk")  # a column of its own, where both come from one table
    return rows.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(work, schema)

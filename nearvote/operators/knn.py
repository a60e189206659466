"""Nearest neighbours: exact in integers, exact in single precision, and in two stages over coarser vectors.

References: ref_id, q16, q8 (arrays), label (1: fraud). Queries: query_id (one row each), q16 and, for two
stages, q8. Distances are exact integers; of equal ones the smaller ref_id comes first, so that results don't
depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Neighbours that vote; the score's denominator also where there are fewer.
K = 5
#: Queries that are sent to all tasks: with 64 dimensions of 8 bytes, 4 MB.
BLOCK = 8192
#: Where there are more: references that a task holds while queries stream past, and queries for which one copy of these is enough.
REF_BLOCK, QUERY_RUN = 1 << 17, 1 << 20
#: Distances of one batch that a task holds, about: 32 MB.
CELLS = 1 << 22
#: Tasks of a grid, at most.
MOST_TASKS = 20_000


def matrix_of(column: pa.Array, dims: int, dtype: type = np.float64) -> np.ndarray:
    """The rows of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if dims < 0 else flat.reshape(-1, dims)


def left_of(q: np.ndarray) -> np.ndarray:
    """With `right_of`, one product of matrices gives all squared distances. Sums of integers are exact while they fit the type."""
    return np.hstack([-2 * q, (q * q).sum(axis=1, keepdims=True), np.ones((len(q), 1), q.dtype)])


def right_of(r: np.ndarray) -> np.ndarray:
    return np.hstack([r, np.ones((len(r), 1), r.dtype), (r * r).sum(axis=1, keepdims=True)])


class Nearest:
    """Of each query the k least rows so far, by distance, rank and id, with some more columns of theirs; with `bounds` only such as are nearer."""

    def __init__(self, queries: int, k: int, more: int = 1, bounds: np.ndarray | None = None) -> None:
        top = np.iinfo(np.int64).max
        self.k, self.distance, self.rank, self.id = k, np.full((queries, k), top), np.full((queries, k), top), np.full((queries, k), top)
        self.more, self.bounds = np.zeros((more, queries, k), np.int64), bounds

    def add(self, of: np.ndarray, d: np.ndarray, ranks: np.ndarray, ids: np.ndarray, more) -> None:
        """d: for the queries `of` (rows) and some references (columns) their distances; ranks: of the queries; more(q, r): columns of pairs."""
        worst = self.distance[of, -1] if self.bounds is None else np.minimum(self.distance[of, -1], self.bounds[of] - 1)
        near = d <= worst.astype(d.dtype)[:, None]
        if d.shape[1] > self.k and near.sum() > 4 * self.k * len(of):
            near &= d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        q, r = np.nonzero(near)
        self.merge(of, q, r, d[q, r].astype(np.int64), ranks, ids, more)

    def merge(self, of: np.ndarray, q: np.ndarray, r: np.ndarray, distances: np.ndarray, ranks: np.ndarray, ids: np.ndarray, more) -> None:
        """The same for some pairs of a query (a row of `of`, ascending) and a reference."""
        if not len(q):
            return
        hit, at = np.unique(q, return_inverse=True)
        rows = of[hit]
        owner = np.concatenate([np.repeat(np.arange(len(hit)), self.k), at])
        distance = np.concatenate([self.distance[rows].ravel(), distances])
        rank, id_ = np.concatenate([self.rank[rows].ravel(), ranks[q]]), np.concatenate([self.id[rows].ravel(), ids[r]])
        order = np.lexsort((id_, rank, distance, owner))
        begins = np.searchsorted(owner[order], np.arange(len(hit)))
        keep = order[(begins[:, None] + np.arange(self.k)[None, :]).ravel()]
        old = len(hit) * self.k
        columns = np.concatenate([self.more[:, rows].reshape(len(self.more), -1), np.zeros((len(self.more), len(q)), np.int64)], axis=1)
        new = keep[keep >= old] - old
        columns[:, new + old] = np.stack(more(q[new], r[new]))
        shape = (len(hit), self.k)
        self.distance[rows], self.rank[rows], self.id[rows] = distance[keep].reshape(shape), rank[keep].reshape(shape), id_[keep].reshape(shape)
        self.more[:, rows] = columns[:, keep].reshape(len(self.more), *shape)

    def rows(self) -> tuple[np.ndarray, ...]:
        """Numbers of queries, distances, ranks, ids, and the further columns."""
        q, at = np.nonzero(self.distance < np.iinfo(np.int64).max)
        return q, self.distance[q, at], self.rank[q, at], self.id[q, at], *self.more[:, q, at]


# ---- exact search


def nearest(refs: DataFrame, queries: DataFrame, k: int = K, vector: str = "q16", block: int = BLOCK, ref_block: int = REF_BLOCK, run: int = QUERY_RUN) -> DataFrame:
    """query_id, rank (from 1), ref_id, label, distance: the k nearest references of every query, by integer vectors.

    Up to `block` queries go to all tasks, and the references are read once where they lie. More of them scan
    those cells of references that may hold one of their nearest (`boxes`), or, where that is most of them,
    stream past blocks of all references (`streamed`). A task keeps k rows for each query, and these alone are
    shuffled. Products of integers below 2**53 are exact in double precision. Raises if a query_id repeats or is null.
    """
    r = refs.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<int>").alias("v"))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<int>").alias("v"))
    found = searched(r, q, k, block, ref_block, run, integers)
    return ranked(found, ["distance", "ref_id"], k)


def nearest_single(refs: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, ref_block: int = REF_BLOCK, run: int = QUERY_RUN) -> DataFrame:
    """query_id, rank, ref_id, label, distance (float): the k nearest by vectors of single precision, `v` on either side.

    A distance is summed in single precision in the order of dimensions; ties by ref_id. A search in double
    precision with a margin for the rounding finds which pairs need that sum. Vectors must be finite.
    """
    r = refs.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<float>").alias("v"))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<float>").alias("v"))
    found = searched(r, q, k, block, ref_block, run, singles)
    return ranked(found, ["distance", "ref_id"], k)


def searched(r: DataFrame, q: DataFrame, k: int, block: int, ref_block: int, run: int, by: Callable) -> DataFrame:
    made = f"query_id long, ref_id long, label int, distance {'long' if by is integers else 'float'}"
    count = q.count()
    if count <= block:
        pdf = q.toPandas()
        ids = pdf["query_id"].to_numpy()
        if len(np.unique(ids)) < count or pdf["query_id"].isna().any():
            raise ValueError("each query needs a query_id of its own")
        vectors = np.stack(pdf["v"].to_numpy()) if count else np.zeros((0, 1))
        held = r.sparkSession.sparkContext.broadcast((ids, vectors))
        return r.mapInArrow(lambda batches: by(*held.value, map(blocked, batches), k), made)
    if q.agg(F.count_distinct("query_id")).first()[0] < count:
        raise ValueError("each query needs a query_id of its own")
    if by is integers:
        from nearvote.operators import boxes

        if (found := boxes.searched(r, q, k, count)) is not None:
            return found

    def build(batches: list[pa.RecordBatch]) -> list[tuple]:
        return [blocked(b) for b in pa.Table.from_batches(batches).combine_chunks().to_batches()]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, some in passed(batches, ("part",), build):
            yield from by(some["id"].to_numpy(), matrix_of(some["v"], -1), block, k)

    return streamed(q, r, *shape(r.count(), count, r.sparkSession.sparkContext.defaultParallelism, ref_block, run)).mapInArrow(work, made)


def shape(refs: int, queries: int, cores: int, ref_block: int = REF_BLOCK, run: int = QUERY_RUN) -> tuple[int, int]:
    """Into how many blocks references are dealt, each of which all queries pass, and into how many runs queries, for each of which references are copied.

    Memory bounds a block, so queries are copied once for each; a run is long, so references seldom are.
    """
    return max(1, -(-refs // ref_block), min(cores, -(-refs // 1024))), max(1, -(-queries // run))


def streamed(queries: DataFrame, refs: DataFrame, blocks: int, runs: int) -> DataFrame:
    """part, kind (0: reference), id, label, v: in a partition each part's references come before the queries that pass them."""
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda c, n, step: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: c + x * step)) if n > 1 else c
    r = refs.select(every(place("ref_id", blocks) * runs, runs, 1).alias("part"), F.lit(0).alias("kind"), F.col("ref_id").alias("id"), "label", "v")
    q = queries.select(every(place("query_id", runs), blocks, runs).alias("part"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.lit(None).cast("long").alias("label"), "v")
    tasks = min(blocks * runs, MOST_TASKS)
    return r.unionByName(q).repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "kind")


def passed(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], build: Callable) -> Iterator[tuple]:
    """What `build` makes of each key's references (kind 0), with each batch of queries that follows them."""
    at, held, block = None, [], None
    for batch in batches:
        columns = [batch[c].to_numpy() for c in (*keys, "kind")]
        changes = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        for i, j in pairwise([0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows] if batch.num_rows else []):
            *key, kind = (int(c[i]) for c in columns)
            if key != at:
                at, held, block = key, [], None
            if kind == 0:
                held.append(batch.slice(i, j - i))
            elif held:
                block = block or build(held)
                yield block, batch.slice(i, j - i)


def blocked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of references."""
    ids = batch["ref_id"] if "ref_id" in batch.schema.names else batch["id"]
    return ids.to_numpy(), batch["label"].to_numpy(), matrix_of(batch["v"], -1 if batch.num_rows else 1, np.float32 if pa.types.is_float32(batch["v"].type.value_type) else np.float64)


def integers(ids: np.ndarray, q: np.ndarray, blocks: Iterable[tuple], k: int, bounds: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The k nearest of some blocks, by integer vectors; with `bounds` only such as are nearer."""
    best, left, every = Nearest(len(ids), k, bounds=bounds), left_of(q.astype(np.float64)), np.arange(len(ids))
    step = max(k + 1, CELLS // max(1, len(ids)))
    for refs, labels, vectors in blocks:
        for i in range(0, len(refs) if len(ids) else 0, step):
            at = slice(i, i + step)
            best.add(every, left @ right_of(vectors[at]).T, np.zeros(len(ids), np.int64), refs[at], lambda _, r, of=labels[at]: [of[r]])
    at, distance, _, ref, label = best.rows()
    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(ref, pa.int64()), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], names=["query_id", "ref_id", "label", "distance"])


def singles(ids: np.ndarray, q: np.ndarray, blocks: Iterable[tuple], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of some blocks, by distances summed in single precision. As bits, these keep their order."""
    q = q.astype(np.float32)
    best, wide, every = Nearest(len(ids), k), q.astype(np.float64), np.arange(len(ids))
    left, own = left_of(wide), (wide * wide).sum(axis=1)
    step, margin = max(k + 1, CELLS // max(1, len(ids))), (q.shape[1] + 4) * 2.0**-23
    for refs, labels, vectors in blocks:
        for i in range(0, len(refs) if len(ids) else 0, step):
            at = slice(i, i + step)
            r = vectors[at].astype(np.float64)
            d = left @ right_of(r).T
            off = 1e-15 * (q.shape[1] + 4) * (own[:, None] + (r * r).sum(axis=1)[None, :])
            least, most = (d - off) * (1 - margin) - 1e-30, (d + off) * (1 + margin) + 1e-30
            worst = np.where(best.distance[:, -1] < 2**31, best.distance[:, -1], 0x7F800000).astype(np.int32).view(np.float32)
            near = least <= worst[:, None]
            if d.shape[1] > k:
                near &= least <= np.partition(most, k - 1, axis=1)[:, k - 1 : k]
            a, b = np.nonzero(near)
            sums = np.zeros(len(a), np.float32)
            for x in range(q.shape[1]):
                apart = vectors[at][b, x] - q[a, x]
                sums += apart * apart
            best.merge(every, a, b, sums.view(np.int32).astype(np.int64), np.zeros(len(ids), np.int64), refs[at], lambda _, r, of=labels[at]: [of[r]])
    at, distance, _, ref, label = best.rows()
    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(ref, pa.int64()), pa.array(label, pa.int32()), pa.array(distance.astype(np.int32).view(np.float32))], names=["query_id", "ref_id", "label", "distance"])


# ---- what searches share


def ranked(rows: DataFrame, order: list[str | Column], k: int, group: tuple[str, ...] = ("query_id",), name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank. Spark cuts to k before the exchange too."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def nearest_two_stage(refs: DataFrame, queries: DataFrame, candidates: int = 32, k: int = K) -> DataFrame:
    """The `candidates` nearest by the 8-bit vectors, and of these the k nearest by the 16-bit ones: query_id, rank, ref_id, label, coarse, distance."""
    from nearvote.operators import ivf

    one = refs.select("ref_id", "q16", "q8", "label", F.lit(0).alias("cell_id"))
    cells = refs.agg(F.count(F.lit(1)).alias("size")).select(F.lit(0).alias("cell_id"), "size")
    whole = F.array(F.lit(0))
    asked = queries.select("query_id", F.lit(0).alias("part"), F.col("q16").alias("query"), F.col("q8").alias("query_q8"), whole.alias("cells"), F.array(F.lit(1)).alias("ranks"))
    pool = ivf.candidates(ivf.Index(one, cells, 0), asked, max(k, candidates))
    return ranked(pool.select("query_id", "ref_id", "label", "coarse", "distance"), ["distance", "coarse", "ref_id"], k)


def voted(neighbours: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id and frauds, the number of neighbours labelled fraud; with `queries`, 0 for those without neighbours."""
    votes = neighbours.groupBy("query_id").agg(F.sum("label").cast("int").alias("frauds"))
    if queries is None:
        return votes
    return queries.select("query_id").join(votes, "query_id", "left").withColumn("frauds", F.coalesce("frauds", F.lit(0)))


def decided(votes: DataFrame) -> DataFrame:
    """Adds fraud_score, frauds of K, and approved: less than 0.6, that is two at most."""
    return votes.withColumns({"fraud_score": F.round(F.col("frauds") / K, 1), "approved": F.col("frauds") < 3})

"""Exact search for many queries: references in the cells of a tree, of which a query scans those whose box may hold one of its k nearest.

The tree is fitted on a sample, every reference goes to one of its cells. A query scans its own cell first;
the k-th distance there is a bound, and only cells whose box is as near are scanned then. Of references with
one vector the k first by id are kept, as no others can be among the k nearest, so copies make no cell heavy.
Where boxes let too much in, as with many independent dimensions, the caller compares all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from nearvote.operators import knn
from nearvote.sources.shared import stored

#: References that the tree is fitted on, about; references of a cell, about; cells, at most: with 64 dimensions their boxes are 17 MB.
SEEN, CELL, MOST_CELLS = 1 << 16, 1 << 10, 1 << 14
#: Queries on which it is seen what boxes let in, about, and the share of all pairs from which on comparing all is no slower.
TRIED, MOST_SHARE = 1 << 12, 1 / 8
#: Pairs of a query and a node that a task holds, about.
PAIRS = 1 << 18


@dataclass
class Tree:
    """By node: the dimension and value at which it is cut, and its first child (0: none), the second follows it. Boxes and sizes once cells are known."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    size: np.ndarray | None = None

    @staticmethod
    def of(points: np.ndarray, cells: int) -> Tree:
        """Cut at medians of the widest spread until a cell has its share of the distinct points."""
        points = np.unique(points, axis=0)
        least, nodes, held, i = max(1, -(-len(points) // cells)), [(0, 0, 0)], [points], 0
        while i < len(nodes):
            some, held[i] = held[i], None
            if len(some) > least:
                dim = int(np.argmax(some.std(axis=0)))
                values = np.sort(some[:, dim])
                cut = values[(len(values) - 1) // 2]
                if cut == values[-1]:
                    cut = values[np.searchsorted(values, cut) - 1]
                nodes[i] = dim, cut, len(nodes)
                left = some[:, dim] <= cut
                nodes += [(0, 0, 0), (0, 0, 0)]
                held += [some[left], some[~left]]
            i += 1
        dim, cut, child = zip(*nodes, strict=True)
        return Tree(np.array(dim), np.array(cut, np.float64), np.array(child))

    def cells(self, v: np.ndarray) -> np.ndarray:
        """The node without children that each vector falls in."""
        at = np.zeros(len(v), np.int64)
        rows = np.flatnonzero(self.child[at])
        while len(rows):
            node = at[rows]
            at[rows] = self.child[node] + (v[rows, self.dim[node]] > self.cut[node])
            rows = rows[self.child[at[rows]] > 0]
        return at

    def boxed(self, cells: DataFrame) -> Tree:
        """With boxes and sizes of all nodes from rows of cell, size, low, high."""
        rows = cells.collect()
        dims = len(rows[0]["low"]) if rows else 1
        low, high, size = np.full((len(self.dim), dims), np.inf), np.full((len(self.dim), dims), -np.inf), np.zeros(len(self.dim), np.int64)
        for r in rows:
            low[r["cell"]], high[r["cell"]], size[r["cell"]] = r["low"], r["high"], r["size"]
        for i in np.flatnonzero(self.child)[::-1]:  # children come after their parents
            two = slice(self.child[i], self.child[i] + 2)
            low[i], high[i], size[i] = low[two].min(axis=0), high[two].max(axis=0), size[two].sum()
        return Tree(self.dim, self.cut, self.child, low, high, size)

    def within(self, v: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a vector's number and a cell, not empty, whose box is no farther from it than its bound."""
        out, q, node = [], np.arange(len(v)), np.zeros(len(v), np.int64)
        while len(q):
            near = self.size[node] > 0
            q, node = q[near], node[near]
            apart = np.maximum(np.maximum(self.low[node] - v[q], v[q] - self.high[node]), 0)
            near = (apart * apart).sum(axis=1) <= bounds[q]
            q, node = q[near], node[near]
            inner = self.child[node] > 0
            out.append((q[~inner], node[~inner]))
            q, node = q[inner], self.child[node[inner]]
            q, node = np.concatenate([q, q]), np.concatenate([node, node + 1])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (q, node)

    def farthest(self, v: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each vector has k references: that of the farthest corner of the smallest node around it that holds so many."""
        found, at, rows = np.full(len(v), np.inf), np.zeros(len(v), np.int64), np.arange(len(v))
        while len(rows):
            rows = rows[self.size[at[rows]] >= k]
            node = at[rows]
            apart = np.maximum(np.abs(v[rows] - self.low[node]), np.abs(v[rows] - self.high[node]))
            found[rows] = np.minimum(found[rows], (apart * apart).sum(axis=1))
            rows, node = rows[self.child[node] > 0], node[self.child[node] > 0]
            at[rows] = self.child[node] + (v[rows, self.dim[node]] > self.cut[node])
        return found


def searched(r: DataFrame, q: DataFrame, k: int, count: int, seen: int = SEEN, cell: int = CELL, most_share: float = MOST_SHARE) -> DataFrame | None:
    """query_id, ref_id, label, distance: of each query its k nearest, and others. None where boxes let in more than `most_share` of all `count` times references pairs.

    r: ref_id, label, v, q: query_id, v, arrays of integers. Vectors with a null are near nothing.
    """
    spark = r.sparkSession
    whole = "forall(v, x -> x is not null)"
    r, q = r.filter(whole), q.filter(whole)
    n = r.count()
    if n * most_share < cell:  # no tree would let in less
        return None
    share = F.pmod(F.xxhash64("ref_id", F.lit("seen")), F.lit(1 << 30)) < min(1 << 30, (seen << 30) // max(1, n))
    points = r.filter(share).select("v").toArrow()["v"].combine_chunks()
    if not len(points):
        return None
    sent = spark.sparkContext.broadcast(Tree.of(knn.matrix_of(points, -1), max(1, min(MOST_CELLS, n // cell))))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(sent.value.cells(knn.matrix_of(b["v"], -1)), pa.int64()))

    # references by a hash of the vector, then the vector itself: numbers are sorted faster than arrays
    alike = W.partitionBy("of", "v").orderBy("ref_id")
    few = r.withColumn("of", F.xxhash64("v")).withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= k)
    refs = stored(few.select("ref_id", "label", "v").mapInArrow(placed, "ref_id long, label long, v array<int>, cell long"), "cells")
    dims = len(points[0])
    box = lambda f: F.array(*[f(F.get("v", F.lit(i))) for i in range(dims)])
    tree = sent.value.boxed(refs.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), box(F.min).alias("low"), box(F.max).alias("high")))
    held = spark.sparkContext.broadcast(tree)
    sizes = F.broadcast(spark.createDataFrame([(int(c), int(tree.size[c])) for c in np.flatnonzero((tree.child == 0) & (tree.size > 0))], "cell long, size long"))

    own = stored(q.mapInArrow(placed, "query_id long, v array<int>, cell long").withColumn("bound", F.lit(None).cast("double")), "own-cells")
    first = stored(scanned(refs, sizes, own, k), "first")
    bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").cast("double").alias("found")).filter(F.col("n") >= k)
    asked = own.drop("bound").join(bounds.select("query_id", "found"), "query_id", "left")
    some = asked.filter(F.pmod(F.xxhash64("query_id", F.lit("tried")), F.lit(1 << 30)) < min(1 << 30, (TRIED << 30) // max(1, count)))
    tried = some.mapInArrow(lambda batches: _rows(batches, held, k), "rows long").agg(F.sum("rows"), F.count(F.lit(1))).first()
    if tried[1] and tried[0] > most_share * n * tried[1]:
        return None
    further = stored(asked.mapInArrow(lambda batches: _further(batches, held, k), "query_id long, v array<int>, cell long, bound double"), "further-cells")
    return first.unionByName(scanned(refs, sizes, further, k))


def _bounded(batches: Iterable[pa.RecordBatch], tree: Tree, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some queries at a time, their bounds, and pairs of a query's number and a cell other than its own that may hold a row as near."""
    step = 256
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            some = batch.slice(i, step)
            v, found = knn.matrix_of(some["v"], -1), some["found"].to_numpy(zero_copy_only=False)
            bounds = np.where(np.isnan(found), tree.farthest(v, k), found)
            at, cells = tree.within(v, bounds)
            apart = cells != some["cell"].to_numpy()[at]
            yield some, bounds, at[apart], cells[apart]
            i += step
            step = int(np.clip(step * PAIRS / max(1, len(at)), 16, 4096))


def _rows(batches: Iterable[pa.RecordBatch], held: Broadcast[Tree], k: int) -> Iterator[pa.RecordBatch]:
    """How many references each query scans."""
    for some, _, at, cells in _bounded(batches, held.value, k):
        rows = np.bincount(at, held.value.size[cells], some.num_rows) + held.value.size[some["cell"].to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64))], names=["rows"])


def _further(batches: Iterable[pa.RecordBatch], held: Broadcast[Tree], k: int) -> Iterator[pa.RecordBatch]:
    for some, bounds, at, cells in _bounded(batches, held.value, k):
        for i in range(0, len(at), 1 << 14):
            x = at[i : i + (1 << 14)]
            picked = some.select(["query_id", "v"]).take(pa.array(x))
            yield pa.RecordBatch.from_arrays([picked["query_id"], picked["v"], pa.array(cells[i : i + (1 << 14)]), pa.array(bounds[x])], names=["query_id", "v", "cell", "bound"])


def scanned(refs: DataFrame, sizes: DataFrame, asked: DataFrame, k: int, ref_block: int = knn.REF_BLOCK, run: int = knn.QUERY_RUN) -> DataFrame:
    """query_id, ref_id, label, distance: the k nearest of each cell for each query that asks it, no farther than its bound (null: any).

    A cell that is large is several blocks, one that many queries ask several runs; a cell that none asks isn't shuffled.
    """
    runs = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / run).cast("int").alias("runs"))
    deals = F.broadcast(sizes.join(runs, "cell").select("cell", F.ceil(F.col("size") / ref_block).cast("int").alias("blocks"), "runs"))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = refs.join(deals, "cell").select("cell", place("ref_id", "blocks").alias("block"), every("runs").alias("run"), F.lit(0).alias("kind"), F.col("ref_id").alias("id"), "label", "v", F.lit(None).cast("double").alias("bound"))
    q = asked.join(deals, "cell").select("cell", every("blocks").alias("block"), place("query_id", "runs").alias("run"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.lit(None).cast("long").alias("label"), "v", "bound")
    keys = ["cell", "block", "run"]
    tasks = max(2 * refs.sparkSession.sparkContext.defaultParallelism, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = r.unionByName(q).repartition(tasks, *keys).sortWithinPartitions(*keys, "kind")

    def build(batches: list[pa.RecordBatch]) -> list[tuple]:
        return [knn.blocked(b) for b in pa.Table.from_batches(batches).combine_chunks().to_batches()]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, some in knn.passed(batches, keys, build):
            bound = some["bound"].to_numpy(zero_copy_only=False)
            most = np.where(np.isfinite(bound), bound, 2.0**62).astype(np.int64) + 1  # those as near as the bound count: their ids may be smaller
            yield from knn.integers(some["id"].to_numpy(), knn.matrix_of(some["v"], -1), block, k, most)

    return rows.mapInArrow(work, "query_id long, ref_id long, label int, distance long")

"""An index of cells for approximate search, and search in it.

Building: centroids (k-means, or given), each reference to its nearest centroid, per cell its size,
offset and bounding box. Search: the references of each query's nearest cells are scanned by 8-bit
vectors, and the nearest ranked again by 16-bit ones. It can stop early for queries whose first cells agree,
go on for those whose vote is close or whose boxes allow more, and keep to a budget of rows.

What a scan of some cells gives is a pool: of each query the nearest rows by 8 bits. Pools of different cells
merge into that of all of them, so a later step scans further cells only. All queries go through
each step together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from nearvote.operators.knn import CELLS, K, QUERY_RUN, REF_BLOCK, Nearest, decided, left_of, matrix_of, passed, ranked, right_of

#: Cells of an index, at most; its centroids and boxes are broadcast: with 64 dimensions under 20 MB.
MOST_CELLS = 65_536
#: Queries, and probes (a query and a cell), that are broadcast, at most: with 64 dimensions under 30 MB, and 34 MB.
FEW_QUERIES, FEW_PROBES = 1 << 15, 1 << 21
#: References of a cell that are compared at once.
TOGETHER = 8192


@dataclass(frozen=True)
class Search:
    """How to search. Percentages are of the cells that are probed; with a row budget (0: none) a query takes no further cell once it has scanned so many rows."""

    probes: int = 8
    candidates: int = 32
    early_stop: bool = True
    early_stop_pct: int = 75
    early_stop_pct_first: int = 0
    early_majority: bool = False
    box_guided: bool = False
    box_repair: bool = False
    borderline_probes: int = 0
    row_budget: int = 0

    def within(self, cells: int) -> Search:
        """The same with values that an index of so many cells can have."""
        return replace(self, probes=min(max(self.probes, 1), max(cells, 1)), candidates=max(self.candidates, K), early_stop_pct=min(max(self.early_stop_pct, 10), 95))


@dataclass(frozen=True)
class Index:
    """refs: ref_id, q16, q8, label, cell_id. cells: cell_id, centroid, size, start, low, high (null in empty cells).

    What `build` returns is computed anew for each action; write it and read it again to search more than once.
    """

    refs: DataFrame
    cells: DataFrame
    dims: int

    def write(self, path: str) -> None:
        """References by cell, so that a search reads the files of the cells it probes. A heavy cell is dealt to several tasks and files."""
        salt = F.pmod(F.xxhash64("ref_id"), F.ceil(F.col("size") / REF_BLOCK))
        dealt = self.refs.join(F.broadcast(self.cells.select("cell_id", "size")), "cell_id").repartition("cell_id", salt).drop("size")
        dealt.sortWithinPartitions("cell_id", "ref_id").write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/refs")
        self.cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    def stored(self, path: str) -> Index:
        self.write(path)
        return Index.read(self.refs.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        cells = spark.read.parquet(f"{path}/cells")
        if cells.filter("size > 0").isEmpty():
            return Index(spark.createDataFrame([], REFS), cells, _dims(cells))
        return Index(spark.read.schema(REFS).parquet(f"{path}/refs"), cells, cells.select(F.size("centroid").alias("n")).first()["n"])


REFS = "ref_id long, q16 array<smallint>, q8 array<tinyint>, label int, cell_id int"


# ---- building


#: Rows of the sample from which first centroids are drawn, for each cell and at most.
SEED_ROWS, MOST_SEED_ROWS = 64, 1 << 16


def trained_centroids(refs: DataFrame, cells: int, iterations: int = 15, seed: int = 42) -> DataFrame:
    """cell_id and centroid by k-means over all references, from first centroids that are drawn far from each other (`seeds`)."""
    return lloyd(refs, seeds(refs, cells, seed), iterations)


def seeds(refs: DataFrame, cells: int, seed: int = 42) -> DataFrame:
    """First centroids by k-means++: each is drawn with a chance in proportion to its squared distance from those before.

    They are drawn from the references that come first by a hash of their ids, 64 for each cell and 65,536 at
    most, so they depend on the seed alone.
    """
    if cells > MOST_CELLS:
        raise ValueError(f"an index has {MOST_CELLS} cells at most")
    order = F.xxhash64("ref_id", F.lit(seed))
    rows = refs.select("ref_id", F.col("q16").cast("array<int>").alias("v"), order.alias("h")).orderBy("h", "ref_id").limit(max(cells, min(SEED_ROWS * cells, MOST_SEED_ROWS))).toPandas()
    x = np.stack(rows["v"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))
    rng, near, chosen = np.random.default_rng(seed), np.full(len(x), np.inf), []
    for _ in range(min(cells, len(x))):
        weight = np.cumsum(near) if chosen else np.arange(1.0, len(x) + 1)
        at = int(np.searchsorted(weight, rng.random() * weight[-1], "right")) if weight[-1] > 0 else int(np.flatnonzero(np.isin(np.arange(len(x)), chosen, invert=True))[0])
        chosen.append(min(at, len(x) - 1))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return refs.sparkSession.createDataFrame([(i, [int(v) for v in x[k]]) for i, k in enumerate(chosen)], "cell_id int, centroid array<int>")


def lloyd(refs: DataFrame, centroids: DataFrame, iterations: int, settled: float = 0.005) -> DataFrame:
    """cell_id and centroid after so many rounds of k-means, or fewer: it ends when less than a share of the references changes its cell.

    In a round each task adds up, in integers, the members of every cell among its rows, and only these sums are
    shuffled and added; so rounds agree whatever the partitions. A centroid is the mean, rounded half up. An empty
    cell c begins anew at the first reference whose id is at least c * 2654435761 mod 2**32 mod their number, or at
    the first of all. What changes its cell is counted in the following pass, which assigns by both sets of centroids.
    """
    ids, points = _points(centroids)
    spark, dims, before = refs.sparkSession, points.shape[1], None
    if not len(ids):
        return centroids
    for n in range(iterations + 1):
        sums, moved, total = _sums(refs, points, before)
        if n == iterations or (before is not None and moved < settled * total):
            break
        before, points = points, points.copy()
        for cell, (size, at) in sums.items():
            points[cell] = np.floor(at / size + 0.5)
        for cell in sorted(set(range(len(ids))) - set(sums)):
            at = int(ids[cell]) * 2654435761 % 2**32 % max(total, 1)
            found = refs.select("ref_id", F.col("q16").cast("array<int>").alias("v")).orderBy(F.col("ref_id") < at, "ref_id").limit(1).collect()
            if found:
                points[cell] = found[0]["v"]
    return spark.createDataFrame([(int(i), [int(v) for v in p]) for i, p in zip(ids, points, strict=True)], "cell_id int, centroid array<int>") if dims else centroids


def _sums(refs: DataFrame, points: np.ndarray, before: np.ndarray | None) -> tuple[dict[int, tuple[int, np.ndarray]], int, int]:
    """For each cell that has members their number and sum; how many references another set of centroids puts elsewhere; and their number."""
    held = refs.sparkSession.sparkContext.broadcast((points, before))
    dims = points.shape[1]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, before = held.value
        sizes, sums, moved = np.zeros(len(points), np.int64), np.zeros((len(points), dims), np.int64), 0
        step, right = max(1, CELLS // len(points)), right_of(points).T
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                x = matrix_of(batch.slice(i, step)["q16"], dims)
                left = left_of(x)
                near = (left @ right).argmin(axis=1)
                if before is not None:
                    moved += int(((left @ right_of(before).T).argmin(axis=1) != near).sum())
                order = np.argsort(near, kind="stable")
                cells, first = np.unique(near[order], return_index=True)
                sizes += np.bincount(near, minlength=len(points))
                sums[cells] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
        at = np.flatnonzero(sizes)
        ends = pa.array(np.arange(0, (len(at) + 1) * dims, dims), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(sizes[at], moved), pa.int64()), pa.ListArray.from_arrays(pa.concat_arrays([ends, ends[-1:]]), pa.array(sums[at].ravel()))], names=["cell", "size", "sums"])

    parts = refs.select("q16").mapInArrow(work, "cell int, size long, sums array<long>")
    total = parts.groupBy("cell").agg(F.sum("size").alias("size"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)]).alias("sums")).collect()
    found = {r["cell"]: (r["size"], np.array(r["sums"])) for r in total if r["cell"] >= 0}
    return found, sum(r["size"] for r in total if r["cell"] < 0), sum(size for size, _ in found.values())


def assigned(refs: DataFrame, centroids: DataFrame) -> DataFrame:
    """References with cell_id, that of the nearest centroid; of equally near ones the lowest."""
    ids, points = _points(centroids)
    held = refs.sparkSession.sparkContext.broadcast((ids, points))
    columns = [c for c in refs.columns if c != "cell_id"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = held.value
        length, step = (points * points).sum(axis=1), max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x = matrix_of(part["q16"], points.shape[1])
                near = (length[None, :] - 2 * (x @ points.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in columns], pa.array(ids[near], pa.int32())], names=[*columns, "cell_id"])

    rows = refs.select(*columns)
    return rows.mapInArrow(work, f"{rows._jdf.schema().toDDL()}, cell_id int")


def _points(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and centroids of all cells, in order; a table of bounded size."""
    if (n := centroids.count()) > MOST_CELLS:
        raise ValueError(f"an index has {MOST_CELLS} cells at most, not {n}")
    pdf = centroids.select("cell_id", "centroid").orderBy("cell_id").toPandas()
    return pdf["cell_id"].to_numpy(np.int64), np.stack(pdf["centroid"].to_numpy()).astype(np.float64) if n else np.zeros((0, 0))


def _dims(centroids: DataFrame) -> int:
    first = centroids.select(F.size("centroid").alias("n")).take(1)
    return first[0]["n"] if first else 0


def cell_table(refs: DataFrame, centroids: DataFrame) -> DataFrame:
    """For each cell its size, where its references begin in the order of cells, and its bounding box."""
    dims = _dims(centroids)
    at = [F.get("q16", F.lit(i)).cast("int") for i in range(dims)]
    by_cell = refs.groupBy("cell_id").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.min(x) for x in at]).alias("low"), F.array(*[F.max(x) for x in at]).alias("high"))
    cells = centroids.join(by_cell, "cell_id", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    return cells.withColumn("start", F.sum("size").over(W.orderBy("cell_id")) - F.col("size"))


def build(refs: DataFrame, centroids: DataFrame) -> Index:
    """An index over references (ref_id, q16, q8, label) and centroids (cell_id, centroid)."""
    in_cells = assigned(refs, centroids)
    return Index(in_cells, cell_table(in_cells, centroids), _dims(centroids))


def recomputed_centroids(refs: DataFrame, centroids: DataFrame) -> DataFrame:
    """Centroids as the means of the members that cells have now, rounded half up; empty cells keep theirs."""
    at = [F.floor(F.avg(F.get("q16", F.lit(i)).cast("long")) + 0.5).cast("int") for i in range(_dims(centroids))]
    means = refs.groupBy("cell_id").agg(F.array(*at).alias("mean"))
    return centroids.join(means, "cell_id", "left").select("cell_id", F.coalesce("mean", "centroid").alias("centroid"))


def statistics(index: Index) -> DataFrame:
    """One row: cells, mean and largest size, empty cells."""
    return index.cells.agg(F.count(F.lit(1)).alias("cells"), F.avg("size").alias("mean_size"), F.max("size").alias("largest"), F.count_if(F.col("size") == 0).alias("empty"))


# ---- search


RANKED = "query_id long, query array<smallint>, query_q8 array<tinyint>, cells array<int>, distances array<long>, scanned array<long>"


def nearest_cells(index: Index, queries: DataFrame, probes: int, guided: bool = False, budget: int = 0, held: Broadcast[Cells] | None = None) -> DataFrame:
    """query_id, query, query_q8; cells: the nearest ones of each query, by centroid or by box; distances; scanned: rows of a cell and those before it.

    By box, cells without members come last. Of equally near cells the lowest comes first. With a
    budget the cells end where so many rows have been scanned.
    """
    held, dims = held or _cells(index), index.dims

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        step = max(1, CELLS // max(1, len(cells.ids)))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                q = matrix_of(batch["query"], dims or -1)
                order, d = cells.nearest(q, probes, guided)
                scanned = np.cumsum(cells.sizes[order], axis=1)
                n = np.minimum(1 + (scanned < budget).sum(axis=1), order.shape[1]) if budget else np.full(len(q), order.shape[1])
                kept = np.arange(order.shape[1])[None, :] < n[:, None]
                ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[kept], t)) for x, t in ((cells.ids[order], pa.int32()), (d, pa.int64()), (scanned, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["query_id"], batch["query"], batch["query_q8"], *lists], names=["query_id", "query", "query_q8", "cells", "distances", "scanned"])

    return _queried(queries).mapInArrow(work, RANKED)


def first_of(d: np.ndarray, k: int) -> np.ndarray:
    """In each row the places of the k least values in order, of equal ones the lowest place first."""
    n = d.shape[1]
    if n <= 4 * k or int(d.max(initial=0)) >= (1 << 62) // n:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    key = d * n + np.arange(n)  # no two alike, so a part of them is enough
    part = np.argpartition(key, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(key, part, axis=1), axis=1), axis=1)


def probed(index: Index, queries: DataFrame, probes: int, guided: bool = False) -> DataFrame:
    """query_id, query, query_q8, cell_id, cell_rank (from 1), cell_distance: a row for each cell of `nearest_cells`."""
    rows = nearest_cells(index, queries, probes, guided).select("query_id", "query", "query_q8", F.posexplode(F.arrays_zip("cells", "distances")).alias("at", "cell"))
    return rows.select("query_id", "query", "query_q8", F.col("cell.cells").alias("cell_id"), (F.col("at") + 1).alias("cell_rank"), F.col("cell.distances").alias("cell_distance"))


def reached(index: Index, rows: DataFrame, first_rank: int) -> DataFrame:
    """rows: query_id, query, query_q8, cells (already scanned), worst. The same with all other cells with members whose box is no farther than `worst` (all, if it is null), their ranks, and how many rows they have."""
    held, dims = _cells(index), index.dims

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            found, more = [], []
            for q, had, worst in zip(matrix_of(batch["query"], dims or -1), batch["cells"].to_pylist(), batch["worst"].to_pylist(), strict=True):
                wanted = (cells.sizes > 0) & ~np.isin(cells.ids, had)
                at = np.flatnonzero(wanted & (cells.to_boxes(q) <= worst) if worst is not None else wanted)
                found.append(cells.ids[at])
                more.append(int(cells.sizes[at].sum()))
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (flat, first_rank + flat)]
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["query"], batch["query_q8"], *lists, pa.array(more, pa.int64())], names=["query_id", "query", "query_q8", "cells", "ranks", "more"])

    return rows.select("query_id", "query", "query_q8", "cells", "worst").mapInArrow(work, "query_id long, query array<smallint>, query_q8 array<tinyint>, cells array<int>, ranks array<int>, more long")


def ranks_of(index: Index, wanted: DataFrame, guided: bool = False) -> DataFrame:
    """wanted: query_id, q16, q8, cells (array). query_id, cell_id, cell_rank of these cells among all, as `probed` ranks them."""
    held, dims = _cells(index), index.dims

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            out = []
            for q, i, of in zip(matrix_of(batch["query"], dims), batch["query_id"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                rank = np.empty(len(cells.ids), np.int64)
                rank[np.argsort(cells.to_boxes(q) if guided else cells.to_centroids(q), kind="stable")] = np.arange(1, len(cells.ids) + 1)
                out += [(i, c, int(rank[k])) for c, k in zip(of, np.searchsorted(cells.ids, of).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 3, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["query_id", "cell_id", "cell_rank"])

    return _queried(wanted, "cells").mapInArrow(work, "query_id long, cell_id int, cell_rank int")


@dataclass(frozen=True)
class Groups:
    """Cells in groups that lie together: places of cells group by group, where each group begins, a ball around its centroids and a box around its boxes."""

    places: np.ndarray
    begins: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(cells: Cells) -> Groups:
        """About as many groups as each has cells, by a few rounds of k-means over the centroids."""
        c, n = cells.centroids, max(1, int(len(cells.ids) ** 0.5))
        centers = c[np.linspace(0, len(c) - 1, n).astype(int)]
        for _ in range(5):
            near = (left_of(c) @ right_of(centers).T).argmin(axis=1)
            centers = np.stack([c[near == g].mean(axis=0) if (near == g).any() else centers[g] for g in range(n)])
        near = (left_of(c) @ right_of(centers).T).argmin(axis=1)
        places = np.argsort(near, kind="stable")
        held = [places[near[places] == g] for g in range(n)]
        held = [(g, x) for g, x in enumerate(held) if len(x)]
        full = [x[cells.sizes[x] > 0] for _, x in held]
        box = lambda of, f, none: np.stack([f(of[x], axis=0) if len(x) else np.full(c.shape[1], none) for x in full])
        begins = np.cumsum([0, *(len(x) for _, x in held)])
        radii = np.array([np.sqrt(((c[x] - centers[g]) ** 2).sum(axis=1)).max() for g, x in held])
        return Groups(np.concatenate([x for _, x in held]), begins, centers[[g for g, _ in held]], radii, box(cells.low, np.min, 2.0**30), box(cells.high, np.max, -(2.0**30)))

    def bounds(self, q: np.ndarray, guided: bool) -> np.ndarray:
        """For each query and group what the distance of any of its cells is at least."""
        if guided:
            apart = [np.maximum(np.maximum(self.low - x, x - self.high), 0) for x in q]
            return np.minimum(np.stack([(d * d).sum(axis=1) for d in apart]), 2.0**62)
        d = np.sqrt(np.maximum(left_of(q) @ right_of(self.centers).T, 0))
        return np.maximum(d * (1 - 1e-9) - self.radii[None, :] * (1 + 1e-9) - 1e-3, 0) ** 2  # less what rounding may take


#: Cells from which groups are looked at first.
GROUPED = 2048


@dataclass(frozen=True)
class Cells:
    ids: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    groups: Groups | None = None

    def nearest(self, q: np.ndarray, k: int, guided: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each query places and distances of the k nearest cells, of equally near ones the lowest first.

        Of many cells only those in groups are compared whose bound is within the k-th distance of the nearest
        groups; so the ranks are those of all cells.
        """
        if self.groups is None or 4 * k > len(self.ids):
            d = np.stack([self.to_boxes(x) for x in q]) if guided else self.to_all_centroids(q)
            order = first_of(d, k)
            return order, np.take_along_axis(d, order, axis=1)
        found = [self._nearest(x, bound, k, guided) for x, bound in zip(q, self.groups.bounds(q, guided), strict=True)]
        return np.stack([p for p, _ in found]), np.stack([d for _, d in found])

    def _nearest(self, q: np.ndarray, bound: np.ndarray, k: int, guided: bool) -> tuple[np.ndarray, np.ndarray]:
        order, sizes = np.argsort(bound), np.diff(self.groups.begins)
        first = int(np.searchsorted(np.cumsum(sizes[order]), 2 * k)) + 1
        places = self._places(order[:first])
        d = self.to_some(q, places, guided)
        rest = order[first:][bound[order[first:]] <= np.partition(d, k - 1)[k - 1]]
        if len(rest):
            more = self._places(rest)
            places, d = np.concatenate([places, more]), np.concatenate([d, self.to_some(q, more, guided)])
        at = np.lexsort((places, d))[:k]
        return places[at], d[at]

    def _places(self, groups: np.ndarray) -> np.ndarray:
        return np.concatenate([self.groups.places[self.groups.begins[g] : self.groups.begins[g + 1]] for g in groups])

    def to_some(self, q: np.ndarray, places: np.ndarray, guided: bool) -> np.ndarray:
        if not guided:
            return ((self.centroids[places] - q) ** 2).sum(axis=1).astype(np.int64)
        d = np.maximum(np.maximum(self.low[places] - q, q - self.high[places]), 0)
        return np.where(self.sizes[places] > 0, (d * d).sum(axis=1), 2.0**62).astype(np.int64)

    def to_centroids(self, q: np.ndarray) -> np.ndarray:
        return ((self.centroids - q) ** 2).sum(axis=1).astype(np.int64)

    def to_all_centroids(self, q: np.ndarray) -> np.ndarray:
        return (left_of(q) @ right_of(self.centroids).T).astype(np.int64) if len(self.ids) else np.zeros((len(q), 0), np.int64)

    def to_boxes(self, q: np.ndarray) -> np.ndarray:
        return self.to_some(q, np.arange(len(self.ids)), True)


def _cells(index: Index) -> Broadcast[Cells]:
    """All cells, a table of bounded size, for the tasks."""
    pdf = index.cells.select("cell_id", "centroid", "size", "low", "high").limit(MOST_CELLS + 1).toPandas().sort_values("cell_id")
    if len(pdf) > MOST_CELLS:
        raise ValueError(f"an index has {MOST_CELLS} cells at most")
    ids = pdf["cell_id"].to_numpy(np.int64)
    centroids = np.stack(pdf["centroid"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 0))
    box = lambda c: np.stack([np.zeros(index.dims) if v is None else np.asarray(v, np.float64) for v in pdf[c]]) if len(pdf) else centroids
    cells = Cells(ids, centroids, pdf["size"].to_numpy(np.int64), box("low"), box("high"))
    return index.refs.sparkSession.sparkContext.broadcast(replace(cells, groups=Groups.of(cells)) if len(ids) >= GROUPED else cells)


def _queried(queries: DataFrame, *more: str) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q16").cast("array<smallint>").alias("query"), F.col("q8").cast("array<tinyint>").alias("query_q8"), *more)


#: Farther than any two 8-bit vectors are.
FAR = 1 << 62
CANDIDATES = "query_id long, part int, ref_id long, label int, cell_rank int, coarse long, distance long"


def candidates(index: Index, asked: DataFrame, most: int) -> DataFrame:
    """The nearest references of some cells by 8-bit distance, `most` for each query and part, with their 16-bit distance.

    asked: query_id, part (one row for both), query, query_q8, cells, ranks (arrays), and perhaps bound: only
    references nearer than it by 8 bits count, so tasks give back few rows. Queries are sent to the
    tasks that read their cells where they are few. More stream past the references of their cells, which a
    task holds in blocks: queries are copied for each block, references only for very long streams, so
    neither a cell with many references nor one that many queries probe is a task of its own.
    """
    spark = index.refs.sparkSession
    refs = index.refs.select("ref_id", "q16", "q8", F.col("label").cast("long").alias("label"), "cell_id")
    bound = F.coalesce("bound", F.lit(FAR)) if "bound" in asked.columns else F.lit(FAR)
    asked = asked.select("query_id", "part", "query", "query_q8", "cells", "ranks", bound.alias("bound"))
    held = asked.limit(FEW_QUERIES + 1).toArrow()
    if held.num_rows <= FEW_QUERIES and (pc.sum(pc.list_value_length(held["cells"])).as_py() or 0) <= FEW_PROBES:
        made = Probes.of(held)
        sent = spark.sparkContext.broadcast(made)
        found = refs.filter(F.col("cell_id").isin(sorted(made.cells))).mapInArrow(lambda batches: _scanned(sent.value, batches, most), CANDIDATES)
    else:
        found = _streamed(index, refs, asked).mapInArrow(lambda batches: _passing(batches, most), CANDIDATES)
    return pooled(found, most)


def pooled(rows: DataFrame, most: int, group: tuple[str, ...] = ("query_id", "part")) -> DataFrame:
    """Of candidates the nearest by 8 bits. A pool of pools is the pool of all their rows."""
    return ranked(rows, ["coarse", "cell_rank", "ref_id"], most, group, "coarse_rank")


@dataclass(frozen=True)
class Probes:
    """ids and parts: of the rows of queries. By cell: numbers of the rows that probe it, and the rank that it has for each. Vectors by number; 8-bit ones ready for `right_of`."""

    ids: np.ndarray
    parts: np.ndarray
    cells: dict[int, tuple[np.ndarray, np.ndarray]]
    left: np.ndarray
    q16: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Probes:
        rows = rows.combine_chunks()
        column = lambda name: rows[name].combine_chunks() if rows.num_rows else rows[name]
        ids, parts = rows["query_id"].to_numpy(), rows["part"].to_numpy()
        if rows["query_id"].null_count or len(np.unique(np.stack([ids, parts]), axis=1).T) < len(ids):
            raise ValueError("each query needs a query_id of its own")
        if not rows.num_rows:
            return Probes(ids, parts, {}, np.zeros((0, 3), np.float32), np.zeros((0, 1)), ids)
        q8, q16 = matrix_of(column("query_q8"), -1, _coarse_type(rows)), matrix_of(column("query"), -1)
        owner = np.repeat(np.arange(len(ids)), pc.list_value_length(rows["cells"]).to_numpy())
        cells, ranks = (pc.list_flatten(rows[c]).to_numpy() for c in ("cells", "ranks"))
        order = np.argsort(cells, kind="stable")
        cuts = np.flatnonzero(np.diff(cells[order], prepend=-1, append=-1)) if len(order) else [0]
        return Probes(ids, parts, {int(cells[order[i]]): (owner[order[i:j]], ranks[order[i:j]].astype(np.int64)) for i, j in pairwise(cuts)}, left_of(q8), q16, rows["bound"].to_numpy())


def _coarse_type(rows: pa.Table | pa.RecordBatch) -> type:
    """Squared distances of 8-bit vectors are exact in single precision below 2**24."""
    dims = len(rows["query_q8"][0]) if rows.num_rows else 0
    return np.float32 if dims * 255**2 < 1 << 24 else np.float64


def _compared(best: Nearest, of: np.ndarray, ranks: np.ndarray, probes: Probes, right: np.ndarray, q16: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    """Distances by 8 bits for all references of a cell, by 16 bits for those that they let in."""
    left, step = probes.left[of], max(best.k + 1, CELLS // max(1, len(of)))
    for i in range(0, len(ids), step):
        at = slice(i, i + step)

        def more(q: np.ndarray, r: np.ndarray, at: slice = at) -> list[np.ndarray]:
            return [labels[at][r], ((probes.q16[of[q]] - q16[at][r]) ** 2).sum(axis=1).astype(np.int64)]

        best.add(of, left @ right[at].T, ranks, ids[at], more)


def _found(probes: Probes, best: Nearest) -> pa.RecordBatch:
    at, coarse, rank, ref, label, distance = best.rows()
    columns = [(probes.ids[at], pa.int64()), (probes.parts[at], pa.int32()), (ref, pa.int64()), (label, pa.int32()), (rank, pa.int32()), (coarse, pa.int64()), (distance, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["query_id", "part", "ref_id", "label", "cell_rank", "coarse", "distance"])


def _scanned(probes: Probes, batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The candidates of some probes among some references."""
    best = Nearest(len(probes.ids), most, 2, probes.bounds)
    for cell, batch in by_cell(batches, probes.cells):
        of, ranks = probes.cells[cell]
        _compared(best, of, ranks, probes, right_of(matrix_of(batch["q8"], -1, probes.left.dtype)), matrix_of(batch["q16"], -1), batch["ref_id"].to_numpy(), batch["label"].to_numpy())
    yield _found(probes, best)


def by_cell(batches: Iterable[pa.RecordBatch], wanted: dict) -> Iterator[tuple[int, pa.RecordBatch]]:
    """References of one cell at a time, about TOGETHER of them. The files of an index hold them cell by cell; others are sorted within batches."""
    cell, held, n = None, [], 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        cells = batch["cell_id"].to_numpy()
        if np.count_nonzero(cells[1:] != cells[:-1]) > 2 * len(np.unique(cells)):
            batch = batch.take(pa.array(np.argsort(cells, kind="stable")))
            cells = np.sort(cells)
        for i, j in pairwise(np.flatnonzero(np.diff(cells, prepend=-1, append=-1)).tolist()):
            if int(cells[i]) in wanted:
                if held and (cell != cells[i] or n >= TOGETHER):
                    yield cell, whole()
                    held, n = [], 0
                cell, n = int(cells[i]), n + j - i
                held.append(batch.slice(i, j - i))
    if held:
        yield cell, whole()


def _streamed(index: Index, refs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each cell, block of references and run of queries: first the references (kind 0), then the queries."""
    probes = asked.select("query_id", "part", "query", "query_q8", "bound", F.explode(F.arrays_zip("cells", "ranks")).alias("c")).select("*", F.col("c.cells").alias("cell_id"), F.col("c.ranks").alias("rank")).drop("c")
    visits = probes.groupBy("cell_id").agg(F.ceil(F.count(F.lit(1)) / QUERY_RUN).cast("int").alias("runs"))
    blocks = F.broadcast(index.cells.select("cell_id", F.ceil(F.col("size") / REF_BLOCK).cast("int").alias("blocks")).join(visits, "cell_id").filter("blocks > 0"))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    empty = lambda kind: F.lit(None).cast(kind)
    r = refs.join(blocks, "cell_id").select("cell_id", place("ref_id", "blocks").alias("block"), every("runs").alias("run"), F.lit(0).alias("kind"), F.col("ref_id").alias("id"), empty("int").alias("part"), empty("int").alias("rank"), empty("long").alias("bound"), "label", "q16", "q8")
    q = probes.join(blocks, "cell_id").select("cell_id", every("blocks").alias("block"), place("query_id", "runs").alias("run"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "part", "rank", "bound", empty("long").alias("label"), F.col("query").alias("q16"), F.col("query_q8").alias("q8"))
    keys = ["cell_id", "block", "run"]
    return r.unionByName(q).repartition(*keys).sortWithinPartitions(*keys, "kind")


def _passing(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The candidates of the queries that pass blocks of references."""

    def build(held: list[pa.RecordBatch]) -> tuple:
        (block,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        dims = len(block["q8"][0])
        kind = np.float32 if dims * 255**2 < 1 << 24 else np.float64
        return right_of(matrix_of(block["q8"], dims, kind)), matrix_of(block["q16"], dims), block["id"].to_numpy(), block["label"].to_numpy()

    for (right, q16, ids, labels), some in passed(batches, ("cell_id", "block", "run"), build):
        probes = Probes(some["id"].to_numpy(), some["part"].to_numpy(), {}, left_of(matrix_of(some["q8"], -1, right.dtype)), matrix_of(some["q16"], -1), some["bound"].to_numpy())
        best = Nearest(len(probes.ids), most, 2, probes.bounds)
        _compared(best, np.arange(len(probes.ids)), some["rank"].to_numpy().astype(np.int64), probes, right, q16, ids, labels)
        yield _found(probes, best)


def reranked(pool: DataFrame, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Of candidates the K nearest by 16-bit distance."""
    return ranked(pool.select(*group, "ref_id", "label", "cell_rank", "coarse", "distance"), ["distance", "coarse", "cell_rank", "ref_id"], K, group)


def summary(neighbours: DataFrame, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """query_id, frauds, worst (distance of the last of K; null where there are fewer)."""
    return neighbours.groupBy(*group).agg(F.sum("label").cast("int").alias("frauds"), F.max(F.when(F.col("rank") == K, F.col("distance"))).alias("worst"))


def checkpoint_of(probes: int, pct: int) -> int:
    """After how many cells a search may stop; 0: never."""
    at = probes * pct // 100
    return at if 0 < at < probes else 0


def agreed(frauds: Column, majority: bool = False) -> Column:
    return (frauds <= 1) | (frauds >= K - 1) if majority else (frauds == 0) | (frauds == K)


def between(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of `nearest_cells` as `candidates` asks for them: the cells of ranks low + 1 to high."""
    cells = F.slice("cells", F.lit(low + 1), F.lit(max(high - low, 0)))
    return rows.select("query_id", F.lit(0).alias("part"), "query", "query_q8", cells.alias("cells"), F.transform(cells, lambda _, i: i + low + 1).alias("ranks")).filter(F.size("cells") > 0)


def grown(index: Index, pool: DataFrame | None, asked: DataFrame, most: int) -> DataFrame:
    """A pool with what some more cells hold, all of higher ranks: of these only rows nearer than the last of a full pool count."""
    if pool is None:
        return candidates(index, asked, most).checkpoint()
    last = pool.filter(F.col("coarse_rank") == most).select("query_id", F.col("coarse").alias("bound"))
    return pooled(pool.unionByName(candidates(index, asked.join(last, "query_id", "left"), most)), most).checkpoint()


def rows_until(n: int) -> Column:
    """How many rows the first n cells of a row of `nearest_cells` have."""
    return F.coalesce(F.get("scanned", F.least(F.lit(n), F.size("scanned")) - 1), F.lit(0).cast("long"))


def search(index: Index, queries: DataFrame, how: Search = Search()) -> DataFrame:  # noqa: B008
    """query_id, frauds, fraud_score, approved, mode (0 full, 1 stopped early, 2 borderline, 3 repaired), rows_scanned, for every query.

    Each cell of a query is scanned once. Queries whose cells are empty have no frauds. Raises if a query_id repeats.
    """
    cells = _cells(index)
    how = how.within(len(cells.value.ids))
    reach = max(how.probes, how.borderline_probes)
    rest = nearest_cells(index, queries, reach, how.box_guided, how.row_budget, cells).checkpoint()
    voted = lambda rows, pool: rows.join(summary(reranked(pool)), "query_id", "left").withColumn("frauds", F.coalesce("frauds", F.lit(0)))
    answer = lambda rows, mode, scanned: rows.select("query_id", "frauds", mode.alias("mode"), scanned.alias("rows_scanned"))
    pool, at, done = None, 0, []
    for pct in (how.early_stop_pct_first, how.early_stop_pct) if how.early_stop and not how.box_repair else ():
        if (stop := checkpoint_of(how.probes, pct)) > at:
            pool, at = grown(index, pool, between(rest, at, stop), how.candidates), stop
            # neighbours agree, and the last one is nearer than the next cell's centroid
            sure = agreed(F.col("frauds"), how.early_majority) & (F.col("worst") < F.get("distances", F.lit(stop)))
            both = voted(rest, pool).withColumn("sure", F.coalesce(sure, F.lit(False))).checkpoint()
            done.append(answer(both.filter("sure"), F.lit(1), rows_until(stop)))
            rest = both.filter("not sure").drop("frauds", "worst", "sure")
            pool = pool.join(rest.select("query_id"), "query_id", "left_semi")

    pool = grown(index, pool, between(rest, at, how.probes), how.candidates)
    full = voted(rest, pool)
    if how.box_repair:
        full = full.withColumn("cells", F.slice("cells", 1, how.probes)).checkpoint()
        boxes = reached(index, full, how.probes + 1).checkpoint()
        pool = grown(index, pool, boxes.select("*", F.lit(0).alias("part")).filter(F.size("cells") > 0), how.candidates)
        wider = voted(full.drop("frauds", "worst", "cells").join(boxes.select("query_id", "cells", "more"), "query_id"), pool)
        done.append(answer(wider, F.when(F.size("cells") > 0, 3).otherwise(0), rows_until(how.probes) + F.col("more")))
    elif how.borderline_probes > how.probes:
        full = full.checkpoint()
        close = F.col("frauds").isin(2, 3)
        done.append(answer(full.filter(~close), F.lit(0), rows_until(how.probes)))
        wide = full.filter(close).drop("frauds", "worst")
        pool = grown(index, pool.join(wide.select("query_id"), "query_id", "left_semi"), between(wide, how.probes, reach), how.candidates)
        done.append(answer(voted(wide, pool), F.lit(2), rows_until(reach)))
    else:
        done.append(answer(full, F.lit(0), rows_until(how.probes)))
    return decided(reduce(DataFrame.unionByName, done))


def neighbours(index: Index, queries: DataFrame, how: Search = Search()) -> DataFrame:  # noqa: B008
    """The K nearest in the probed cells: query_id, rank, ref_id, label, distance."""
    cells = _cells(index)
    how = how.within(len(cells.value.ids))
    rows = nearest_cells(index, queries, how.probes, how.box_guided, how.row_budget, cells).checkpoint()
    return reranked(candidates(index, between(rows, 0, how.probes), how.candidates)).select("query_id", "rank", "ref_id", "label", "distance")


def cell_visits(probes: DataFrame) -> DataFrame:
    """How many queries probe each cell."""
    return probes.groupBy("cell_id").agg(F.count(F.lit(1)).alias("visits"))


PERCENTAGES = (60, 70, 75, 80, 85, 90)


def what_if_answers(index: Index, queries: DataFrame, how: Search, percentages: tuple[int, ...] = PERCENTAGES) -> DataFrame:
    """query_id, pct, checkpoint, frauds, unanimous, slack, passed, full: how each query would stop after a percentage of its cells.

    slack (double): how much farther the next cell's centroid is than the last neighbour, infinite where no cell is
    left, and minus infinity where there are fewer than K neighbours. It passes if its neighbours agree and slack
    is above zero. full: frauds of the whole search. All percentages come from one scan: cells between two
    checkpoints make a pool, and the pools up to a checkpoint are merged.
    """
    how = how.within(index.cells.count())
    at = {pct: min(max(how.probes * pct // 100, 1), how.probes) for pct in percentages}
    stops = sorted({*at.values(), how.probes})
    rows = nearest_cells(index, queries, how.probes, how.box_guided, how.row_budget).checkpoint()
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(low).alias("low"), F.lit(high - low).alias("n")) for k, (low, high) in enumerate(pairwise([0, *stops]))]))
    asked = rows.withColumn("s", spans).withColumn("held", F.slice("cells", F.col("s.low") + 1, F.col("s.n"))).select("query_id", "s.part", "query", "query_q8", F.col("held").alias("cells"), F.transform("held", lambda _, i: i + F.col("s.low") + 1).alias("ranks"))
    pools = candidates(index, asked.filter(F.size("cells") > 0), how.candidates)
    by = ("query_id", "upto")
    upto = pools.withColumn("upto", F.explode(F.sequence(F.col("part"), F.lit(len(stops) - 1))))
    votes = summary(reranked(pooled(upto, how.candidates, by), by), by)
    held = rows.select("query_id", "distances", F.posexplode(F.array(*map(F.lit, stops))).alias("upto", "stop")).join(votes, list(by), "left")
    held = held.select("query_id", "stop", F.coalesce("frauds", F.lit(0)).alias("frauds"), "worst", F.get("distances", F.col("stop")).alias("next")).checkpoint()
    asked_for = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.lit(c).alias("checkpoint")) for p, c in at.items()]))
    each = held.select(F.col("stop").alias("checkpoint"), *[c for c in held.columns if c != "stop"]).join(F.broadcast(held.sparkSession.range(1).select(asked_for.alias("x")).select("x.*")), "checkpoint")
    same = F.col("worst").isNotNull() & agreed(F.col("frauds"))
    slack = F.when(F.col("worst").isNull(), F.lit(float("-inf"))).when(F.col("next").isNull(), F.lit(float("inf"))).otherwise((F.col("next") - F.col("worst")).cast("double"))
    full = held.filter(F.col("stop") == how.probes).select("query_id", F.col("frauds").alias("full"))
    return each.join(full, "query_id").select(
        "query_id", "pct", "checkpoint", "frauds", same.alias("unanimous"), slack.alias("slack"), (same & (slack > 0)).alias("passed"), "full",
    )


def least_passing(answers: DataFrame) -> DataFrame:
    """query_id, least_pct: the smallest percentage after which a query may stop, -1 if there is none."""
    return answers.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("passed"), F.col("pct"))), F.lit(-1)).alias("least_pct"))


def what_if(index: Index, queries: DataFrame, how: Search, percentages: tuple[int, ...] = PERCENTAGES) -> DataFrame:
    """For each percentage: pct, checkpoint, queries, how many could stop there, and how many of these would be answered otherwise."""
    rows = what_if_answers(index, queries, how, percentages)
    changed = F.count_if(F.col("passed") & ((F.col("frauds") < 3) != (F.col("full") < 3)))
    return rows.groupBy("pct", "checkpoint").agg(F.count(F.lit(1)).alias("queries"), F.count_if("passed").alias("stopped"), changed.alias("changed"))

"""Cells of like size: splitting heavy cells, and moving members of full cells to others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearvote.functions.vectors import squared_distance
from nearvote.operators.ivf import assigned

#: A heavy cell is split into so many at most, by as many rounds of k-means over a sample of so many members.
MOST_PARTS, ROUNDS, SAMPLE = 16, 12, 20_000


def heavy_cells(refs: DataFrame, most: int) -> DataFrame:
    """cell_id, size, parts of the cells with more than `most` members."""
    sizes = refs.groupBy("cell_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most)
    return sizes.withColumn("parts", F.least(F.ceil(F.col("size") / most), F.lit(MOST_PARTS)).cast("int"))


def split_centroids(refs: DataFrame, centroids: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """Centroids in which each heavy cell gives way to several, found by k-means over a bounded sample of its members.

    The parts of a cell take its number and numbers after the last one. Assign the references again.
    """
    heavy = heavy_cells(refs, most)
    order = F.row_number().over(W.partitionBy("cell_id").orderBy(F.xxhash64("ref_id", F.lit(seed)), "ref_id"))
    members = refs.join(F.broadcast(heavy), "cell_id").withColumn("n", order).filter(F.col("n") <= SAMPLE)

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        x, k = np.stack(pdf.sort_values("n")["q16"].to_numpy()).astype(np.float64), int(pdf["parts"].iloc[0])
        c = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(ROUNDS):
            near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).argmin(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        return pd.DataFrame({"cell_id": [int(pdf["cell_id"].iloc[0])] * k, "part": range(k), "centroid": [[int(round(v)) for v in row] for row in c]})

    found = members.select("cell_id", "parts", "n", "q16").groupBy("cell_id").applyInPandas(parts, "cell_id int, part int, centroid array<int>")
    last = centroids.agg(F.max("cell_id").alias("last"))
    extra = F.row_number().over(W.orderBy("cell_id", "part"))
    added = found.filter("part > 0").withColumn("cell_id", (last.scalar() + extra).cast("int")).select("cell_id", "centroid")
    first = found.filter("part = 0").select("cell_id", F.col("centroid").alias("new"))
    return centroids.join(first, "cell_id", "left").select("cell_id", F.coalesce("new", "centroid").alias("centroid")).unionByName(added)


#: Bits of a digit in `first_places`: so many counts of a cell stand in one task.
DIGIT = 16


def _digits(rows: DataFrame, cell: str, value: Column, state: DataFrame, within: Column | None) -> DataFrame:
    """state: cell, place. For each cell the value at that place among its rows, taken as 64 bits without sign, and the place among rows with that value.

    Digit by digit from the highest: rows of each digit are counted, and the digit that holds the place is
    looked for among these counts alone. Digits that all rows share are skipped.
    """
    spread = rows.agg(F.bit_or(value).alias("some"), F.bit_and(value).alias("all")).first()
    if spread["some"] is None:
        return state.withColumn("value", F.lit(0).cast("long"))
    differ = (spread["some"] ^ spread["all"]) & (1 << 64) - 1
    top = -(-differ.bit_length() // DIGIT) * DIGIT
    same = spread["all"] & (1 << 64) - 1 & ~((1 << top) - 1)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    state = state.withColumn("value", F.lit(signed(same)).cast("long"))
    for shift in range(top - DIGIT, -1, -DIGIT):
        high = lambda c, s=shift: F.call_function("shiftrightunsigned", c, F.lit(s + DIGIT)) if s + DIGIT < 64 else F.lit(0).cast("long")
        both = rows.withColumn("_v", value).join(F.broadcast(state), cell).filter(high(F.col("_v")) == high(F.col("value")))
        both = both if within is None else both.filter(within)
        digit = F.call_function("shiftrightunsigned", F.col("_v"), F.lit(shift)).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counted = both.groupBy(cell, "place", "value", digit.alias("digit"), *([c for c in state.columns if c not in (cell, "place", "value")])).agg(F.count(F.lit(1)).alias("n"))
        counted = counted.withColumn("before", F.sum("n").over(W.partitionBy(cell).orderBy("digit")) - F.col("n"))
        chosen = counted.filter((F.col("before") < F.col("place")) & (F.col("place") <= F.col("before") + F.col("n")))
        state = chosen.withColumns({"value": F.col("value").bitwiseOR(F.call_function("shiftleft", F.col("digit"), F.lit(shift))), "place": F.col("place") - F.col("before")}).drop("digit", "n", "before").checkpoint()
    return state


def first_places(rows: DataFrame, places: DataFrame, cell: str, distance: str = "d", id_col: str = "ref_id") -> DataFrame:
    """The rows of each cell that come first by distance, then id: as many as `places` (cell, place) says. Cells without a place have none.

    The distance at that place, and the id among rows of this distance, are found by counting, so the rows of a
    cell never stand in one task. Distances are integers from 0 on; ids are distinct.
    """
    full = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).join(places, cell).filter("place > 0").checkpoint()
    whole, cut = full.filter("_n <= place").select(cell), full.filter("_n > place").select(cell, F.col("place").cast("long").alias("place"))
    every = rows.join(F.broadcast(whole), cell, "left_semi")
    if cut.isEmpty():
        return every
    some = rows.join(F.broadcast(cut.select(cell)), cell, "left_semi")
    by_distance = _digits(some, cell, F.col(distance).cast("long"), cut, None).withColumnRenamed("value", "_far")
    sortable = F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    by_id = _digits(some, cell, sortable, by_distance, F.col(distance) == F.col("_far"))
    last = F.broadcast(by_id.select(cell, "_far", F.col("value").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("_id")))
    kept = some.join(last, cell).filter((F.col(distance) < F.col("_far")) | ((F.col(distance) == F.col("_far")) & (F.col(id_col) <= F.col("_id"))))
    return every.unionByName(kept.select(*every.columns))


def rebalanced(refs: DataFrame, centroids: DataFrame, slack: float, passes: int = 30, dims: int | None = None) -> DataFrame:
    """References in cells of (1 + slack) times the mean size at most: the farthest members of a full cell go to the nearest cell with room.

    In a pass each surplus member asks its nearest cell that has room; a cell takes those that are
    nearest to it as long as there is room. It ends when no cell is too full, or after `passes`. ref_id must be
    distinct. Which members stay, and which are taken, is found by counting (`first_places`).
    """
    n, cells = refs.count(), centroids.count()
    cap = int(np.ceil(n / max(cells, 1) * (1 + slack)))
    dims = dims or centroids.select(F.size("centroid").alias("n")).first()["n"]
    held = F.broadcast(centroids.select(F.col("cell_id").alias("to"), F.col("centroid").alias("to_centroid")))
    current = refs
    for _ in range(passes):
        sizes = current.groupBy("cell_id").agg(F.count(F.lit(1)).alias("size")).checkpoint()
        full = sizes.filter(F.col("size") > cap).select("cell_id")
        if full.isEmpty():
            break
        room = centroids.select("cell_id").join(sizes, "cell_id", "left").select(F.col("cell_id").alias("to"), (F.lit(cap) - F.coalesce("size", F.lit(0))).alias("place")).filter("place > 0").checkpoint()
        at_home = current.join(F.broadcast(full), "cell_id", "left_semi").join(held.withColumnRenamed("to", "cell_id"), "cell_id").select("ref_id", "cell_id", "q16", squared_distance("q16", "to_centroid", dims).alias("d")).checkpoint()
        stay = first_places(at_home, full.withColumn("place", F.lit(cap)), "cell_id").select("ref_id")
        surplus = at_home.join(stay, "ref_id", "left_anti").select("ref_id", "q16")
        free = centroids.join(room.withColumnRenamed("to", "cell_id"), "cell_id", "left_semi")
        asks = assigned(surplus, free).withColumnRenamed("cell_id", "to").join(held, "to").select("ref_id", "to", squared_distance("q16", "to_centroid", dims).alias("d")).checkpoint()
        taken = first_places(asks, room, "to").select("ref_id", F.col("to").alias("new"))
        current = current.join(taken, "ref_id", "left").withColumn("cell_id", F.coalesce("new", "cell_id")).drop("new").checkpoint()
    return current

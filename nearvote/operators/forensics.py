"""Why a search has missed: where a query's true neighbours lie in the order of its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearvote.operators.ivf import Index, Search, ranks_of
from nearvote.operators.knn import nearest


def neighbour_cells(index: Index, queries: DataFrame, how: Search, top: int = 20) -> DataFrame:
    """query_id, rank, ref_id, label, distance, cell_id, cell_rank, stage: of the true nearest, and whether the search reads their cells.

    stage: S1 for the first cells, S2 for those of the wider search of close votes, OUT for others.
    """
    cells = index.cells.count()
    how = how.within(cells)
    true = nearest(index.refs, queries, top).join(index.refs.select("ref_id", "cell_id"), "ref_id").checkpoint()
    held = true.groupBy("query_id").agg(F.sort_array(F.collect_set("cell_id")).alias("cells"))  # `top` at most
    order = ranks_of(index, queries.join(held, "query_id"), how.box_guided)
    stage = F.when(F.col("cell_rank") <= how.probes, "S1").when(F.col("cell_rank") <= how.borderline_probes, "S2").otherwise("OUT")
    return true.join(order, ["query_id", "cell_id"]).withColumn("stage", stage)


def coverage(found: DataFrame) -> DataFrame:
    """By query: neighbours, frauds among them, and how many of either the search's cells hold."""
    seen = F.col("stage") != "OUT"
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("label").cast("long").alias("frauds"), F.count_if(seen).alias("covered"), F.count_if(seen & (F.col("label") == 1)).alias("covered_frauds"))

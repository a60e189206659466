"""Seeded workloads that are hard to search: uniform, jittered, and between cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearvote.functions.quantize import q8_vector, q16_vector


def _queries(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", q16_vector(F.col("v")).alias("q16"), q8_vector(F.col("v")).alias("q8"))


def _drawn(seed: int, i: Column, of: str = "query_id") -> Column:
    """The i-th uniform number in [0, 1) of a row, 40 bits of MD5 of its id, so it depends neither on partitions nor on the engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", of, F.lit(seed), i).cast("binary")), 1, 10), 16, 10).cast("long")
    return bits / F.lit(float(1 << 40))


def uniform(spark: SparkSession, n: int, dims: int, seed: int = 7, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """n queries, uniform in [low, high] in each dimension."""
    rows = spark.range(n).withColumnRenamed("id", "query_id")
    return _queries(rows.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.lit(low) + _drawn(seed, i) * (high - low))))


def jittered(queries: DataFrame, sigma: float, dims: int, seed: int = 42) -> DataFrame:
    """Queries (query_id, v array<double>) with normal noise, clamped to [0, 1]; -1 becomes 0."""
    noise = lambda i: F.sqrt(-2 * F.ln(1 - _drawn(seed, i))) * F.cos(2 * F.pi() * _drawn(seed + 1, i))
    moved = F.transform(F.slice("v", 1, dims), lambda x, i: F.greatest(F.least(x + sigma * noise(i), F.lit(1.0)), F.lit(0.0)))
    return _queries(queries.withColumn("v", moved))


def between_cells(spark: SparkSession, centroids: DataFrame, n: int, dims: int, seed: int = 13) -> DataFrame:
    """n queries on the lines between two centroids drawn by hash, from 0.4 to 0.6 of the way."""
    cells = centroids.count()
    u = [_drawn(seed, F.lit(k)) for k in range(3)]
    rows = spark.range(n).withColumnRenamed("id", "query_id").withColumns({"a": F.floor(u[0] * cells), "b": F.floor(u[1] * cells), "t": 0.4 + 0.2 * u[2]})
    place = F.broadcast(centroids.select(F.col("cell_id").cast("long").alias("cell"), "centroid"))
    both = rows.join(place.withColumnsRenamed({"cell": "a", "centroid": "ca"}), "a").join(place.withColumnsRenamed({"cell": "b", "centroid": "cb"}), "b")
    mixed = [(F.get("ca", F.lit(i)) * (1 - F.col("t")) + F.get("cb", F.lit(i)) * F.col("t")) / 10_000 for i in range(dims)]
    return _queries(both.withColumn("v", F.array(*mixed)))

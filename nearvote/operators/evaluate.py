"""How good and how fast: confusion, composite score, percentiles, disagreement, comparison of runs."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def confusion(results: DataFrame, expected: DataFrame, on: str = "query_id") -> DataFrame:
    """tp, tn, fp, fn; a rejected transaction counts as positive. `expected` has expected_approved."""
    both = results.join(expected, on)
    count = lambda a, e: F.count_if((F.col("approved") == a) & (F.col("expected_approved") == e))
    return both.agg(count(False, False).alias("tp"), count(True, True).alias("tn"), count(False, True).alias("fp"), count(True, False).alias("fn"))


def composite(p99: Column, fp: Column, fn: Column, errors: Column, n: Column) -> dict[str, Column]:
    """Scores of latency and detection and their sum, from counts and the 99th percentile in milliseconds."""
    log10 = F.log10
    latency = F.when(p99 <= 0, 0.0).when(p99 > 2000, -3000.0).otherwise(1000.0 * log10(1000.0 / F.greatest(p99, F.lit(1.0))))
    weighted = (fp + 3 * fn + 5 * errors).cast("double")
    rate = F.when(n > 0, weighted / n).otherwise(0.0)
    failures = F.when(n > 0, (fp + fn + errors) / n).otherwise(0.0)
    detection = F.when(failures > 0.15, -3000.0).otherwise(1000.0 * log10(1.0 / F.greatest(rate, F.lit(0.001))) - 300.0 * log10(1.0 + weighted))
    return {"latency_score": latency, "detection_score": detection, "final_score": latency + detection}


def placed(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Each group's distinct values with _all, how many values the group has, and _end, at which place the last of a value stands.

    Values are ranked by their counts, in ranges of values: a window holds the distinct values of one
    range, and only the ranges' totals are added up in one place.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.repartitionByRange(*[F.col(c) for c in (*group, value)]).withColumn("_range", F.spark_partition_id()).checkpoint()
    every = W.partitionBy(*group)
    ranges = counted.groupBy(*group, "_range").agg(F.sum("_n").alias("_in")).withColumns({"_all": F.sum("_in").over(every), "_before": F.sum("_in").over(every.orderBy("_range")) - F.col("_in")})
    ranges = ranges.drop("_in").withColumnsRenamed({c: f"_of_{c}" for c in (*group, "_range")})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, "_range")])
    both = counted.join(ranges if group else F.broadcast(ranges), same).drop(*[f"_of_{c}" for c in (*group, "_range")])
    return both.withColumn("_end", F.col("_before") + F.sum("_n").over(W.partitionBy(*group, "_range").orderBy(value)))


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999), group: list[str] | None = None) -> DataFrame:
    """Exact percentiles: of n sorted values the one at place floor(n * share), counted from 0."""
    group = group or []
    at = lambda s: F.least(F.floor(F.col("_all") * F.lit(s)), F.col("_all") - 1)
    found = [F.min(F.when(F.col("_end") > at(s), F.col(value))).alias("p" + f"{s * 100:g}".replace(".", "_")) for s in shares]
    return placed(rows, value, group).groupBy(*group).agg(F.max("_all").alias("n"), *found)


def middles(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """The group's columns and `median`: the mean of the two values in the middle, which may be one. Groups without values have no row."""
    at = lambda n: F.min(F.when(F.col("_end") > n, F.col(value))).cast("double")
    both = placed(rows, value, group).groupBy(*group).agg(at(F.floor((F.col("_all") - 1) / 2)).alias("low"), at(F.floor(F.col("_all") / 2)).alias("high"))
    return both.select(*group, ((F.col("low") + F.col("high")) / 2).alias("median"))


def disagreement(a: DataFrame, b: DataFrame, on: str = "query_id") -> DataFrame:
    """One row: queries, how many are decided otherwise, their share, mean and largest difference of scores."""
    both = a.select(on, F.col("approved").alias("_a"), F.col("frauds").alias("_fa")).join(b.select(on, F.col("approved").alias("_b"), F.col("frauds").alias("_fb")), on)
    apart = F.abs(F.col("_fa") - F.col("_fb")) / 5
    return both.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("_a") != F.col("_b")).alias("otherwise"), F.avg((F.col("_a") != F.col("_b")).cast("int")).alias("share"), F.avg(apart).alias("mean_apart"), F.max(apart).alias("most_apart"))


def recall(found: DataFrame, true: DataFrame, on: tuple[str, ...] = ("query_id", "ref_id")) -> DataFrame:
    """One row: true neighbours, how many of them were found, and their share."""
    both = true.select(*on).join(found.select(*on).distinct().withColumn("_found", F.lit(1)), list(on), "left")
    return both.agg(F.count(F.lit(1)).alias("neighbours"), F.count("_found").alias("found"), (F.count("_found") / F.count(F.lit(1))).alias("recall"))


def histogram(results: DataFrame) -> DataFrame:
    return results.groupBy("fraud_score").agg(F.count(F.lit(1)).alias("queries"))


def flipping(answers: DataFrame, on: str = "query_id") -> DataFrame:
    """Of repeated answers: the queries that have been answered in more than one way, and in how many."""
    return answers.groupBy(on).agg(F.countDistinct("frauds").alias("answers")).filter("answers > 1")


def by_dimension(a: DataFrame, b: DataFrame, on: str, vector: str) -> DataFrame:
    """For each dimension of two tables of vectors: rows that differ, and by how much at most."""
    both = a.select(on, F.col(vector).alias("_a")).join(b.select(on, F.col(vector).alias("_b")), on)
    each = both.select(F.posexplode(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("long") - y.cast("long")))).alias("dim", "d"))
    return each.groupBy("dim").agg(F.count_if(F.col("d") > 0).alias("differ"), F.max("d").alias("most"))


def over_runs(runs: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Median, mean and sample deviation over runs."""
    found = runs.groupBy(*group).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    middle = middles(runs, value, group).withColumnsRenamed({c: f"_{c}" for c in group})
    return found.join(middle, same, "left").select(*group, "runs", "median", "mean", "deviation")


def without_warm_up(runs: DataFrame, arm: str = "arm", cycle: str = "cycle", order: str = "started") -> DataFrame:
    """Runs without the first one of each arm's cycle."""
    return runs.withColumn("_n", F.row_number().over(W.partitionBy(arm, cycle).orderBy(order))).filter("_n > 1").drop("_n")


def welch(runs: DataFrame, value: str, arm: str, first: str, second: str) -> DataFrame:
    """One row: means and medians of two arms, their differences, and t, degrees of freedom and p of Welch's test.

    t, df and p are null with fewer than two runs in an arm, or without spread.
    """
    of = lambda f, name: f(F.when(F.col(arm) == name, F.col(value)))
    one = runs.agg(*[of(f, name).alias(f"{k}{i}") for i, name in ((1, first), (2, second)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    middle = middles(runs.filter(F.col(arm).isin(first, second)), value, [arm]).checkpoint()  # two rows
    one = one.select("*", *[middle.filter(F.col(arm) == name).select("median").scalar().alias(f"d{i}") for i, name in ((1, first), (2, second))])
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    tested = (F.col("n1") > 1) & (F.col("n2") > 1) & (s1 + s2 > 0)
    t, df = (F.col("m2") - F.col("m1")) / F.sqrt(s1 + s2), (s1 + s2) * (s1 + s2) / (s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1))
    found = one.select(
        F.col("n1").alias("runs_first"), F.col("n2").alias("runs_second"), F.col("m1").alias("mean_first"), F.col("m2").alias("mean_second"), (F.col("m2") - F.col("m1")).alias("difference"),
        F.col("d1").alias("median_first"), F.col("d2").alias("median_second"), (F.col("d2") - F.col("d1")).alias("median_difference"),
        F.when(tested, t).alias("t"), F.when(tested, df).alias("df"),
    )
    return found.withColumn("p", p_value(F.col("t"), F.col("df")))


def medians(runs: DataFrame, values: list[str], group: list[str] | None = None) -> DataFrame:
    """The aggregate of several runs: their number, and the median of each value."""
    group = group or []
    found = runs.groupBy(*group).agg(F.count(F.lit(1)).alias("runs"))
    for v in values:
        middle = middles(runs, v, group).withColumnsRenamed({"median": v, **{c: f"_{c}" for c in group}})
        if group:
            found = found.join(middle, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]), "left").drop(*[f"_{c}" for c in group])
        else:
            found = found.select("*", middle.scalar().alias(v))
    return found


def comparison(runs: DataFrame, values: list[str], arm: str, first: str, second: str) -> DataFrame:
    """A row for each value (column `metric`): what `welch` says, and the change of the medians in percent (null from 0)."""
    rows = []
    for v in values:
        found = welch(runs, v, arm, first, second).withColumn("change_pct", F.when(F.col("median_first") != 0, F.col("median_difference") * 100 / F.col("median_first")))
        rows.append(found.select(F.lit(v).alias("metric"), "*"))
    return reduce(DataFrame.unionByName, rows)


#: Points of the quadrature of `p_value`.
POINTS = 64


def quadrature() -> tuple[list[float], list[float]]:
    import numpy as np

    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    return nodes.tolist(), weights.tolist()


def p_value(t: Column, df: Column) -> Column:
    """Two-sided, of Student's t: the share of the density's area beyond |t|, by numeric integration.

    With x = sqrt(df) * tan(u) the density is a power of a cosine on a bounded interval; the area is
    taken up to where nothing is left of it, by Gauss-Legendre points on either side of |t|.
    """
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in zip(*quadrature(), strict=True)])
    far = F.least(F.lit(math.pi / 2), 40 / F.sqrt(df))
    at = F.least(F.atan(F.abs(t) / F.sqrt(df)), far)

    def area(low: Column, high: Column) -> Column:
        u = lambda p: (high - low) / 2 * p["x"] + (high + low) / 2
        return F.aggregate(points, F.lit(0.0), lambda total, p: total + p["w"] * F.pow(F.greatest(F.cos(u(p)), F.lit(0.0)), df - 1)) * (high - low) / 2

    inner, outer = area(F.lit(0.0), at), area(at, far)
    return F.when(t.isNotNull(), F.least(outer / (inner + outer), F.lit(1.0)))


def workload_stats(workload: DataFrame) -> DataFrame:
    """total, frauds, legit, their shares, and the share of close votes (two or three of five)."""
    fraud = ~F.col("expected_approved")
    edge = F.round(F.col("expected_fraud_score") * 5).isin(2, 3)
    return workload.agg(F.count(F.lit(1)).alias("total"), F.count_if(fraud).alias("frauds"), F.count_if(~fraud).alias("legit"), F.avg(fraud.cast("int")).alias("fraud_rate"), F.avg(edge.cast("int")).alias("edge_rate"))

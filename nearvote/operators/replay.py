"""Replay of a workload under many configurations against a ground truth that is computed once.

The tool by which parameters are picked: exact scores are kept as a table, each configuration's answers are
compared with them, and the rows that differ can be looked at.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.operators import ivf
from nearvote.operators.knn import decided, nearest, voted

#: Names of settings in a configuration's text, letters in either case, and the field that each sets.
SETTINGS = {
    "np": "probes", "nprobe": "probes", "kp": "candidates", "kprime": "candidates", "bnp": "borderline_probes", "borderline_nprobe": "borderline_probes",
    "bbg": "box_guided", "bbox_guided": "box_guided", "bbr": "box_repair", "bbox_repair": "box_repair", "es": "early_stop", "early_stop": "early_stop",
    "espct": "early_stop_pct", "early_stop_pct": "early_stop_pct", "espct1": "early_stop_pct_first", "em": "early_majority", "early_majority": "early_majority",
}
SWITCHES = ("box_guided", "box_repair", "early_stop", "early_majority")


def parsed(text: str) -> ivf.Search:
    """A configuration from its text, such as "NP=8,KP=32,BNP=32,ESPCT=75"; parts that aren't NAME=NUMBER are skipped, other names raise."""
    found: dict[str, int | bool] = {}
    for part in text.split(","):
        name, mark, value = part.partition("=")
        if not mark or "=" in value:
            continue
        if (field := SETTINGS.get(name.strip().lower())) is None:
            raise ValueError(f"no setting {name.strip()!r}; there are {', '.join(SETTINGS)}")
        found[field] = bool(int(value)) if field in SWITCHES else int(value)
    return ivf.Search(**found)


def grid(probes: Iterable[int] = (8,), candidates: Iterable[int] = (32, 48), borderline: Iterable[int] = (16, 32, 48, 64), **fixed) -> list[ivf.Search]:
    """All combinations."""
    wide, kept = tuple(borderline), tuple(candidates)
    return [ivf.Search(probes=p, candidates=k, borderline_probes=b, **fixed) for p in probes for k in kept for b in wide]


def ground_truth(refs: DataFrame, queries: DataFrame, cache: str | None = None, tag: str = "plain") -> DataFrame:
    """query_id, frauds, fraud_score, approved by exact search. With `cache`, a folder, the table is kept there by what the queries are and a tag for the references, and read if it is there."""
    spark = refs.sparkSession
    of = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("query_id", "q16")), F.lit(0)).alias("h"), F.coalesce(F.sum(F.xxhash64("q16", "query_id").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    path = f"{cache}/truth-{tag}-{of['n']}-{of['h'] & (1 << 64) - 1:x}-{int(of['s']) & (1 << 64) - 1:x}"
    if cache and (held := _read(spark, path)) is not None:
        return held
    found = decided(voted(nearest(refs, queries), queries))
    if cache is None:
        return found
    found.write.mode("overwrite").parquet(path)
    return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that has been written to its end, or None."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.schema("query_id long, frauds int, fraud_score double, approved boolean").parquet(path)


def between(queries: DataFrame, truth: DataFrame, low: float = 0.30, high: float = 0.80) -> DataFrame:
    """The queries whose true score is in [low, high]: those that are hard to get right."""
    return queries.join(truth.filter(F.col("fraud_score").between(low, high)).select("query_id"), "query_id", "left_semi")


def differing(results: DataFrame, truth: DataFrame, kind: str | None = None, most: int | None = None) -> DataFrame:
    """query_id, kind (fp or fn), fraud_score, true_score of the answers that decide otherwise than the truth; the first `most` by id, or all."""
    found = compared(results, truth).filter("kind <> 'same'").select("query_id", "kind", "fraud_score", "true_score")
    found = found if kind is None else found.filter(F.col("kind") == kind)
    return found if most is None else found.orderBy("query_id").limit(most)


def compared(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers beside the truth. A rejected transaction is a positive: fn was approved and should not have been."""
    true = truth.select("query_id", F.col("approved").alias("true_approved"), F.col("frauds").alias("true_frauds"), F.col("fraud_score").alias("true_score"))
    kind = F.when(F.col("approved") == F.col("true_approved"), "same").when(F.col("approved"), "fn").otherwise("fp")
    return results.join(true, "query_id").withColumns({"kind": kind, "apart": F.abs(F.col("frauds") - F.col("true_frauds")) / 5})


def replay(index: ivf.Index, queries: DataFrame, truth: DataFrame, configurations: Iterable[ivf.Search]) -> DataFrame:
    """A row for each configuration: its settings, queries, fn, fp, otherwise, mean and most apart, rows scanned a query, and the first id that is missed."""
    rows = []
    for how in configurations:
        both = compared(ivf.search(index, queries, how), truth)
        settings = [F.lit(getattr(how, c)).alias(c) for c in ("probes", "candidates", "borderline_probes", "box_guided", "box_repair", "early_stop_pct")]
        rows.append(
            both.agg(
                F.count(F.lit(1)).alias("queries"), F.count_if(F.col("kind") == "fn").alias("fn"), F.count_if(F.col("kind") == "fp").alias("fp"),
                F.count_if(F.col("kind") != "same").alias("otherwise"), F.avg("apart").alias("mean_apart"), F.max("apart").alias("most_apart"),
                F.avg("rows_scanned").alias("mean_scanned"), F.min(F.when(F.col("kind") == "fn", F.col("query_id"))).alias("first_fn"),
            ).select(*settings, "*")
        )
    return reduce(DataFrame.unionByName, rows)

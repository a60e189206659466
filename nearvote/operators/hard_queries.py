"""A decision tree that tells from its features which queries can't stop early."""

from __future__ import annotations

import re

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F


def trained(telemetry: DataFrame, depths: tuple[int, ...] = (3, 4, 5, 6, 7, 8), least: int = 200, seed: int = 42) -> tuple[DecisionTreeClassificationModel, DataFrame]:
    """telemetry: f0, f1, ..., mode. The tree with the best F1 on a fifth held out, and a row of scores for each depth.

    mode 0 is the class that is looked for. Both classes weigh alike; the split is drawn by hash within each.
    """
    spark = telemetry.sparkSession
    names = [c for c in telemetry.columns if c.startswith("f") and c[1:].isdigit()]
    rows = telemetry.withColumn("label", (F.col("mode") == 0).cast("double")).withColumn("_test", F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(5)) == 0)
    rates = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(rates.values())
    weight = F.when(F.col("label") == 1.0, total / 2 / max(rates.get(1.0, 0), 1)).otherwise(total / 2 / max(rates.get(0.0, 0), 1))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumn("weight", weight)).select("features", "label", "weight", "_test").cache()
    best, scores = None, []
    try:
        for depth in depths:
            model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, weightCol="weight", seed=seed).fit(ready.filter(~F.col("_test")))
            r = model.transform(ready.filter("_test")).agg(F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)).alias("tp"), F.count_if((F.col("prediction") == 1) & (F.col("label") == 0)).alias("fp"), F.count_if((F.col("prediction") == 0) & (F.col("label") == 1)).alias("fn")).first()
            f1 = 2 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1)
            scores.append((depth, model.numNodes, r["tp"], r["fp"], r["fn"], float(f1)))
            if best is None or f1 > best[0]:
                best = f1, model
    finally:
        ready.unpersist()
    return best[1], spark.createDataFrame(scores, "depth int, nodes int, tp long, fp long, fn long, f1 double")


def as_column(model: DecisionTreeClassificationModel, names: list[str]) -> Column:
    """The tree as one expression over the columns `names`: its prediction, inside generated code."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in model.toDebugString.splitlines()[1:] if x.strip()]

    def branch(at: int) -> tuple[Column, int]:
        depth, text = lines[at]
        if text.startswith("Predict"):
            return F.lit(float(text.split(":")[1])), at + 1
        number, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", text).groups()
        yes, at = branch(at + 1)
        assert lines[at][0] == depth and lines[at][1].startswith("Else")
        no, at = branch(at + 1)
        return F.when(F.col(names[int(number)]) <= float(bound), yes).otherwise(no), at

    return branch(0)[0]


def save(model: DecisionTreeClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> DecisionTreeClassificationModel:
    return DecisionTreeClassificationModel.load(path)

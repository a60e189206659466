"""Writers: responses, indexes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: The scores in the responses.
SCORES = ("0", "0.2", "0.4", "0.6", "0.8", "1")


def responses(decisions: DataFrame, id_col: str = "query_id") -> DataFrame:
    """id and body: {"approved": ..., "fraud_score": ...}, one of six texts; a score is snapped to the nearest of them."""
    at = F.least(F.greatest(F.round(F.col("fraud_score") * 5), F.lit(0)), F.lit(5)).cast("int")
    body = F.get(F.array(*[F.lit(f'{{"approved":{"true" if i < 3 else "false"},"fraud_score":{s}}}') for i, s in enumerate(SCORES)]), at)
    return decisions.select(id_col, body.alias("body"))


def write_responses(decisions: DataFrame, path: str, id_col: str = "query_id") -> None:
    responses(decisions, id_col).write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as comma-separated values with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

"""Scoring of requests: in batches and as streams, each micro-batch through the batch functions.

Rows keep what identifies them; the search sees each distinct vector once, and answers are joined back by
vector. So a request that is sent again, or without an id, gets the answer that it gets alone. What can't be
searched goes to a second output with its reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from nearvote import schemas
from nearvote.functions.features import vectorized
from nearvote.functions.quantize import q8_vector
from nearvote.operators.ivf import Index, Search
from nearvote.operators.scorers import scorer

Sink = Callable[[DataFrame, int], None]


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of requests from files of JSON lines; a line that can't be read is in _corrupt."""
    stream = spark.readStream.schema(f"{schemas.REQUEST}, _corrupt string").option("mode", "PERMISSIVE")
    return stream.option("columnNameOfCorruptRecord", "_corrupt").json(path)


def as_queries(transactions: DataFrame) -> DataFrame:
    """id, q16, q8, and reason why a request can't be answered: malformed (its line is in `line`), incomplete (without a time that can be read), or null."""
    rows = vectorized(transactions)
    line = F.col("_corrupt") if "_corrupt" in rows.columns else F.lit(None).cast("string")
    reason = F.when(line.isNotNull(), "malformed").when(F.exists("q16", lambda x: x.isNull()), "incomplete")
    return rows.select("id", "q16", q8_vector(F.transform("q16", lambda x: x / F.lit(10_000.0))).alias("q8"), reason.alias("reason"), line.alias("line"))


def answered(rows: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (q16, q8 and any others) with what `score` says of their vectors: one row out for each row in, whatever their ids."""
    asked = rows.select("q16", "q8").distinct().withColumn("query_id", F.monotonically_increasing_id()).checkpoint()
    found = score(asked).join(asked, "query_id").drop("query_id")
    return rows.join(found, ["q16", "q8"])


def score_stream(
    queries: DataFrame, index: Index | None, sink: Sink | None, checkpoint: str, name: str = "ivf", how: Search = Search(), available_now: bool = True, rejected: Sink | None = None,  # noqa: B008
) -> StreamingQuery:
    """Score a stream of queries (q16, q8, and others) in micro-batches.

    `sink` gets the rows with their decisions and the number of the batch, `rejected` those with a `reason`.
    Without a sink nothing is scored, and no index is needed: a stream that only says what it rejects.
    Ranking over rows isn't possible on a stream itself, so it is done in foreachBatch. With sinks that
    overwrite by batch number each row is answered, or rejected, once, also after a restart.
    """
    score = scorer(name)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if sink is not None:
                good = batch.filter("reason is null").drop("reason", "line") if "reason" in batch.columns else batch
                sink(answered(good, lambda asked: score(index, asked, how)), number)
            if rejected is not None and "reason" in batch.columns:
                rejected(batch.filter("reason is not null").select("id", "reason", "line"), number)
        finally:
            batch.unpersist()

    writer = queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

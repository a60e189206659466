"""The corpus pipeline: from raw documents to token ids of a mix without toxic texts and copies.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; all but the
last return the columns of documents.

In all stages null text counts as empty, rows with a null id stay rows of their own, columns beside those
of documents are kept as they are (up to the mix), and an empty table gives an empty one. Of rows repeated
under one id, equal texts become one in exact_dedup; different ones are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.bpe import digests, public_ranks, round_trip
from nearvote.llm.common import prepare, stored, table, without
from nearvote.llm.exact_dedup import deduplicated
from nearvote.llm.minhash import near_duplicates, text_hash
from nearvote.llm.mixing import drawn
from nearvote.llm.toxicity import toxicity_chain, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts that the classifier chain rejects go. It is fitted on labelled rows of these documents."""
    prepare(spark)
    return without_toxic(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the largest doc_id stays."""
    prepare(spark)
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each component of near-duplicates the document with the smallest doc_id stays. Texts without words stay."""
    prepare(spark)
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id", F.col("text_hash").alias("_text_hash")).distinct()
    return without(docs.withColumn("_text_hash", text_hash()), gone).drop("_text_hash")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the blocks of words that the mix takes, as rows of documents; those taken twice stand twice. Texts without words go."""
    prepare(spark)
    return drawn(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids of each row, and digests of the ids and of the bytes that they decode to."""
    prepare(spark)
    rows = round_trip(docs, *public_ranks())
    return digests(rows, carry=("ids",))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("byte_bpe", byte_bpe)]

#: Classifiers and byte-level BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}-{name}")
    return docs

"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by a hash of a prefix, then by a hash of the whole text. A row goes on
to the next, costlier step only while its group has another row. What survives a step is handed to the
scan of the next one as a bit filter sized by its keys, so no text is shuffled; the filter's false hits
cost a hash, never a wrong group, since the last step counts rows by length and full hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.common import filled, marked, table, without

#: Characters of the prefix that the second step hashes.
PREFIX_CHARS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, ties, full_hash and the columns in `carry`.

    Of rows with identical texts the one with the largest id stays (kept, and keep_id for all of them).
    full_hash is null where an earlier step found no second row. Null text counts as empty. A null id
    never wins against another id; where all ids of a group are null, keep_id is null and all stay.
    Rows repeated under one id count in group_size and are marked alike; ties is the number of rows with
    the id that stays. An empty table gives no rows. Other columns of `docs` don't matter unless named in
    `carry`.
    """
    rows = docs.select(F.col(id_col).alias("_id"), filled(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("_len", F.octet_length("_text"))

    lengths = rows.groupBy("_len").count().filter("count > 1").select("_len").checkpoint()
    rows = marked(rows, lengths, "_second").withColumn("_prefix", F.xxhash64(F.substring("_text", 1, prefix_chars)))

    prefixes = rows.filter("_second").groupBy("_len", "_prefix").count().filter("count > 1").select("_len", "_prefix").checkpoint()
    rows = marked(rows, prefixes, "_third")

    full = rows.withColumn("_full", F.when(F.col("_second") & F.col("_third"), F.sha2("_text", 256))).drop("_text", "_second", "_third")
    groups = full.filter("_full is not null").groupBy("_len", "_full", "_id").agg(F.count(F.lit(1)).alias("_same"))
    groups = groups.groupBy("_len", "_full").agg(F.max("_id").alias("_keep"), F.sum("_same").alias("_n"), F.coalesce(F.max_by("_same", "_id"), F.sum("_same")).alias("_ties")).filter("_n > 1")
    # rows without a full hash get a key of their own: nulls would all go to one task
    keyed = full.withColumn("_key", F.coalesce("_full", F.concat_ws("-", F.lit(""), "_id", "_prefix")))
    joined = keyed.join(groups.select(F.col("_full").alias("_key"), "_keep", "_n", "_ties"), "_key", "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    one = F.lit(1).cast("long")
    return joined.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_n", one).alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"),
        F.coalesce("_ties", one).alias("ties"), F.col("_full").alias("full_hash"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one for each text, also where rows are repeated under its id or have none."""
    id_, content = F.col(id_col).alias("_id_"), F.xxhash64(filled(text_col)).alias("_content_")
    found = exact_groups(docs.select(id_col, text_col, content), id_col, text_col, carry=("_content_",)).filter("not kept or ties > 1")
    found = found.select(F.col(id_col).alias("_id_"), "_content_", "kept").checkpoint()
    rows = without(docs.select("*", id_, content), found.filter("not kept").drop("kept"))
    tied = found.filter("kept").drop("kept").distinct().checkpoint()
    if not tied.isEmpty():
        both = marked(rows, tied, "_tied_")
        rows = both.filter("not _tied_").unionAll(both.filter("_tied_").withColumn("_hash_", F.sha2(filled(text_col), 256)).dropDuplicates(["_id_", "_hash_"]).drop("_hash_")).drop("_tied_")
    return rows.select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_sha256", F.sha2(filled(), 256))
    return exact_groups(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

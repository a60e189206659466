"""What the operators of this subpackage share: folders, reading, batches, range cuts, bit filters."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearvote.sources.shared import bucketed, gone_at_exit, new_path, shared_dir, stored  # noqa: F401

#: Rows in an Arrow batch. Long texts are cut again by size inside the tasks.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators need of a session: small Arrow batches, unless they are smaller yet, and a checkpoint folder.

    Results are lazy, so the setting stays: it is read when they are computed.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    shared_dir(spark)
    return spark


def removed(df: DataFrame) -> None:
    """Delete what `stored` has written. All that is read from now on must begin at tables and checkpoints written since."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver notice which shuffles and checkpoints nothing refers to any more, so that Spark deletes their files now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str | Column = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def by_size(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about `most` bytes, or one row."""
    for batch in batches:
        begun = held = 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begun, i - begun)
                begun, held = i, 0
            held += int(n)
        if begun < batch.num_rows:
            yield batch.slice(begun)


def gathered(batches: Iterable[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Put batches together until the texts of each hold `least` bytes, but for the last one."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def cuts_of(df: DataFrame, column: str, parts: int) -> list:
    """Up to parts - 1 values that cut the column into ranges of like row counts, to about a quarter.

    The driver receives only these quantiles; a column of nulls or an empty table has no cuts.
    """
    error = max(1e-5, min(0.002, 0.25 / parts))
    found = df.approxQuantile(column, [i / parts for i in range(1, parts)], error) if parts > 1 else []
    return sorted({int(x) for x in found})


def range_of(column: Column, cuts: list) -> Column:
    """The number of the range that a value falls in: how many cuts are at or below it. Null: 0.

    A binary search in one array; its steps are the powers of two below the number of cuts.
    """
    if not cuts:
        return F.lit(0)
    held = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) <= column, low + step).otherwise(low))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a filter for each key: so many as long as it stays within MOST_BITS (32 MB), and so many at least.
KEY_BITS, LEAST_BITS, MOST_BITS = 64, 8, 1 << 28


def bit_filter(keys: DataFrame, bits: int) -> Column:
    """A scalar subquery of one array of `bits` bits (a power of two, 64 at least), set at xxhash64 of the rows of `keys`."""
    spark = keys.sparkSession
    at = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_mask(F.col("at"))).alias("mask"))
    every = spark.range(bits >> 6).withColumnRenamed("id", "word").join(words, "word", "left")
    packed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("w"))
    return packed.select(F.transform("w", lambda x: x["mask"]).alias("bits")).scalar()


def passes(filter_: Column, bits: int, *keys: Column) -> Column:
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    return F.get(filter_, F.shiftright(at, 6).cast("int")).bitwiseAND(_mask(at)) != 0


def _mask(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def marked(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """`rows` with a boolean column `name`: true where the columns that `keys` has are those of a row of `keys`, seldom elsewhere.

    `keys` is counted, so it should be a checkpoint. The rows meet a bit filter, sized by the count, in
    their scan; of those without a key one in 64 passes, or one in 8 where there are many millions of
    keys. More keys than the largest filter may hold are joined, and then none passes.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(64, 1 << (KEY_BITS * n).bit_length()))
    if LEAST_BITS * n <= MOST_BITS and bits:
        return rows.withColumn(name, passes(bit_filter(keys, bits), bits, *[F.col(c) for c in keys.columns]))
    held = keys.distinct().select(*[F.col(c).alias(f"_{c}_of_key") for c in keys.columns], F.lit(True).alias("_is_key"))
    both = rows.join(held, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}_of_key")) for c in keys.columns]), "left")
    return both.select(*rows.columns, F.coalesce("_is_key", F.lit(False)).alias(name))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `rows` whose columns that `gone` has are those of no row of `gone`. Only rows that a filter lets pass are shuffled."""
    gone = gone.checkpoint()
    both = marked(rows, gone, "_maybe")
    other = gone.select(*[F.col(c).alias(f"_{c}_gone") for c in gone.columns]).distinct()
    unsure = both.filter("_maybe").join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}_gone")) for c in gone.columns]), "left_anti")
    return both.filter("not _maybe").unionAll(unsure).drop("_maybe")

"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where all run on one machine a new folder. Checkpoints go there too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="nearvote-"))
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path there that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there, and any executor can read it. It is gone when the driver ends."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As `stored`, dealt by a column: what groups or joins by it later reads the table where it lies, without a shuffle."""
    path, made = new_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(made)
    gone_at_exit(df.sparkSession, path)
    found = df.sparkSession.table(made)
    found.schema  # resolved, so the name isn't needed any more; files of a table with a path stay
    df.sparkSession.sql(f"DROP TABLE {made}")
    return found


def gone_at_exit(spark: SparkSession, path: str) -> None:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)

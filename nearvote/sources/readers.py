"""Readers of requests, labelled vectors, workloads, telemetry and results of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote import schemas
from nearvote.functions.features import DIMS, LIMIT_NAMES, Limits
from nearvote.functions.quantize import q16_vector, q8_vector


def read_requests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Transactions as JSON, one to a line or one array; fields that don't fit are null and the row is in _corrupt."""
    schema = f"{schemas.REQUEST}, _corrupt string"
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


#: A string, which stays, or a comma before a closing bracket.
LAST_COMMA = r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])'


def read_references(spark: SparkSession, path: str, dims: int = DIMS, multi_line: bool = True, last_commas: bool = False) -> DataFrame:
    """Labelled vectors as JSON, also compressed: ref_id (a hash of the content), q16, q8, label (1: fraud). Anything malformed raises.

    One array in one file is read by one task: write the result as Parquet before it is used often. With
    `last_commas` each file is one array, in which a comma may stand before a closing bracket.
    """
    if last_commas:
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", LAST_COMMA, "$1").alias("value"))
        each = F.from_json("value", f"array<struct<{schemas.REFERENCE}>>", {"mode": "FAILFAST", "allowComments": "true"})
        return validated(text.select(F.explode(each).alias("r")).select("r.*"), dims)
    rows = spark.read.schema(schemas.REFERENCE).option("multiLine", multi_line).option("allowComments", True).option("mode", "FAILFAST").json(path)
    return validated(rows, dims)


def validated(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """vector and label, checked and quantized; ref_id is a hash of both, so it doesn't depend on files or partitions. Rows that are alike share it."""
    right = F.coalesce((F.size("vector") == dims) & F.col("label").isin("fraud", "legit"), F.lit(False))
    checked = rows.withColumn("_ok", F.when(right, True).otherwise(F.raise_error(F.lit("a reference needs all dimensions and a label of fraud or legit"))))
    return checked.filter("_ok").select(F.xxhash64("vector", "label").alias("ref_id"), q16_vector(F.col("vector")).alias("q16"), q8_vector(F.col("vector")).alias("q8"), (F.col("label") == "fraud").cast("int").alias("label"))


def read_workload(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Requests with what is expected of them: the request's columns, expected_approved, expected_fraud_score."""
    rows = spark.read.schema(schemas.WORKLOAD).option("multiLine", True).json(path).select(F.explode("entries").alias("e"))
    rows = rows.select("e.request.*", "e.expected_approved", "e.expected_fraud_score")
    return rows if limit is None else rows.limit(limit)


def read_raw_workload(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """As `read_workload`, with each request as it was sent beside the parsed columns: `raw`, a VARIANT, also of fields that the schema lacks."""
    whole = spark.read.option("singleVariantColumn", "v").option("multiLine", multi_line).json(path)
    each = whole.lateralJoin(spark.tvf.variant_explode(F.variant_get(F.col("v").outer(), "$.entries", "variant"))).select(F.col("value").alias("e"))
    parsed = F.from_json(F.to_json(F.variant_get("e", "$.request", "variant")), schemas.REQUEST)
    rows = each.select(
        parsed.alias("request"), F.variant_get("e", "$.expected_approved", "boolean").alias("expected_approved"),
        F.variant_get("e", "$.expected_fraud_score", "float").alias("expected_fraud_score"), F.variant_get("e", "$.request", "variant").alias("raw"),
    )
    return rows.select("request.*", "expected_approved", "expected_fraud_score", "raw")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Files of comma-separated values without a header: features of a query, rows scanned, mode."""
    return spark.read.schema(schemas.TELEMETRY).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of runs as JSON, one to a file."""
    return spark.read.schema(schemas.RUN).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_limits(spark: SparkSession, constants: str, risks: str | None = None) -> Limits:
    """Constants of the features from JSON files: one object of numbers, and one of merchant categories (of four characters) and risks."""
    said = json.loads(_text(spark, constants))
    held = {field: float(said[name]) for field, name in LIMIT_NAMES.items()}
    if risks is None:
        return Limits(**held)
    table = {k: float(v) for k, v in json.loads(_text(spark, risks)).items()}
    if wrong := [k for k in table if len(k) != 4]:
        raise ValueError(f"merchant categories have four characters, not {wrong[0]!r}")
    return Limits(**held, mcc_risk=table)


def _text(spark: SparkSession, path: str) -> str:
    """A small file, from wherever Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]

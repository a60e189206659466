"""The driver's tables as references, queries and transactions, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from nearvote.functions.quantize import q8_vector, q16_vector
from nearvote.operators import ivf
from nearvote.sources.shared import new_path, shared_dir

#: With 12 cells of the fixed index, and 10 of one by k-means, recall of the five nearest is 0.95 and more (README).
DIMS, NLIST, PROBES, TRAINED_PROBES, CANDIDATES = 64, 16, 12, 10, 32
#: A row of `embeddings` counts as fraud from this label on.
FRAUD_LABEL = 7


#: Indexes that this application has stored, by folder, time and size of the table.
_STORED: dict[tuple[str, str, int, int], ivf.Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared_dir(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & (F.size("embedding") == DIMS) & ~F.exists("embedding", lambda x: x.isNull()))
    return rows.select(F.col("vec_id").alias("ref_id"), q16_vector(F.col("embedding")).alias("q16"), q8_vector(F.col("embedding")).alias("q8"), (F.col("label") >= FRAUD_LABEL).cast("int").alias("label"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference whose id is divisible by 100, against all references."""
    return references(spark, sf_dir).filter("ref_id % 100 = 0").withColumnRenamed("ref_id", "query_id").drop("label")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed centroids, so that SQL can compute the same cells: the first references."""
    return references(spark, sf_dir).filter(F.col("ref_id") < NLIST).select(F.col("ref_id").cast("int").alias("cell_id"), F.col("q16").cast("array<int>").alias("centroid"))


def index(spark: SparkSession, sf_dir: str) -> ivf.Index:
    """Built and stored by cell once for an application and folder; all queries read what is stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/embeddings.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = spark.sparkContext.applicationId, sf_dir, files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()
    if at not in _STORED:
        _STORED[at] = ivf.build(references(spark, sf_dir), centroids(spark, sf_dir)).stored(new_path(spark, "index"))
    return _STORED[at]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each order, nested as requests are: the customer's earlier orders are its history."""
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    lines = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("lines"), F.max("l_suppkey").alias("supplier"), F.sum("l_quantity").alias("quantity"))
    history = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumns({"before": F.lag("o_orderdate").over(history), "known": F.collect_set("supplier").over(history.rowsBetween(-3, -1)), "nth": F.row_number().over(history)})
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mcc = F.element_at(F.array(*[F.lit(m) for m in ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000")]), (F.col("supplier") % 11 + 1).cast("int"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.struct((F.col("o_totalprice") / 64).alias("amount"), F.col("lines").alias("installments"), iso("o_orderdate").alias("requested_at")).alias("transaction"),
        F.struct((F.col("c_acctbal") / 8).alias("avg_amount"), F.col("nth").alias("tx_count_24h"), "known").alias("customer"),
        F.struct(F.col("supplier").cast("string").alias("id"), mcc.alias("mcc"), (F.col("quantity") * 16).alias("avg_amount")).alias("merchant"),
        F.struct((F.col("o_orderkey") % 2 == 0).alias("is_online"), (F.col("o_orderkey") % 3 == 0).alias("card_present"), (F.col("quantity") / 4).alias("km_from_home")).alias("terminal"),
        F.when(F.col("before").isNotNull(), F.struct(iso("before").alias("timestamp"), (F.col("quantity") * 2).alias("km_from_current"))).alias("last_transaction"),
    ).withColumn("customer", F.col("customer").withField("known_merchants", F.transform("customer.known", lambda s: s.cast("string"))).dropFields("known"))


# ---- the same in SQL

Q16 = "round_even(x * 10000::FLOAT, 0)::BIGINT"
V = f"""v AS (SELECT vec_id, (label >= {FRAUD_LABEL})::INTEGER AS label,
  list_transform(embedding, lambda x: {Q16}) AS q16,
  list_transform(embedding, lambda x: greatest(-128, least(127, round_even(x * 127::FLOAT, 0)))::BIGINT) AS q8 FROM embeddings)"""


def distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))::BIGINT"


def box(q: str, low: str, high: str) -> str:
    d = f"greatest({low}[i] - {q}[i], {q}[i] - {high}[i], 0)"
    return f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: {d} * {d}))::BIGINT"


PAIRS = f"""{V},
p AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, b.label, {distance('a.q16', 'b.q16')} AS distance, {distance('a.q8', 'b.q8')} AS coarse
      FROM v a, v b WHERE a.vec_id % 100 = 0)"""
EXACT = f"""{PAIRS},
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM p) WHERE rank <= 5),
vote AS (SELECT query_id, sum(label)::INTEGER AS frauds FROM nn GROUP BY query_id)"""
TWO_STAGE = f"""{PAIRS},
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse, ref_id) AS r FROM p) WHERE r <= {CANDIDATES}),
nn2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, coarse, ref_id) AS rank FROM c) WHERE rank <= 5),
vote2 AS (SELECT query_id, sum(label)::INTEGER AS frauds FROM nn2 GROUP BY query_id)"""
ASSIGNED = f"""{V},
cc AS (SELECT vec_id AS cell_id, q16 AS centroid FROM v WHERE vec_id < {NLIST}),
a AS (SELECT vec_id AS ref_id, label, q16, q8, cell_id FROM (SELECT v.*, cell_id, row_number() OVER (PARTITION BY vec_id ORDER BY {distance('q16', 'centroid')}, cell_id) AS r FROM v, cc) WHERE r = 1)"""
CELLS = f"""{ASSIGNED},
d AS (SELECT cell_id, i, min(q16[i]) AS low, max(q16[i]) AS high FROM a, (SELECT unnest(range(1, {DIMS + 1})) AS i) GROUP BY cell_id, i),
b AS (SELECT cell_id, list(low ORDER BY i) AS low, list(high ORDER BY i) AS high FROM d GROUP BY cell_id),
n AS (SELECT cell_id, count(*) AS size FROM a GROUP BY cell_id),
cells AS (SELECT cc.cell_id, centroid, coalesce(size, 0) AS size, (sum(coalesce(size, 0)) OVER (ORDER BY cc.cell_id) - coalesce(size, 0))::BIGINT AS start, low, high
          FROM cc LEFT JOIN n USING (cell_id) LEFT JOIN b USING (cell_id))"""
PROBES_SQL = f"""{CELLS},
every AS (SELECT query_id, query, query_q8, cell_id, cell_distance, row_number() OVER (PARTITION BY query_id ORDER BY cell_distance, cell_id) AS cell_rank
  FROM (SELECT v.vec_id AS query_id, v.q16 AS query, v.q8 AS query_q8, cell_id, {distance('v.q16', 'centroid')} AS cell_distance FROM v, cc WHERE v.vec_id % 100 = 0))"""


def searched(name: str, probes: str) -> str:
    """CTEs: <name>_s has query_id, frauds, worst, rows_scanned of a search over some probes (query_id, query, query_q8, cell_id, cell_rank)."""
    return f"""{name}_p AS (SELECT e.query_id, e.cell_rank, a.ref_id, a.label, {distance('a.q16', 'e.query')} AS distance, {distance('a.q8', 'e.query_q8')} AS coarse
  FROM ({probes}) e JOIN a USING (cell_id)),
{name}_c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse, cell_rank, ref_id) AS r FROM {name}_p) WHERE r <= {CANDIDATES}),
{name}_n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, coarse, cell_rank, ref_id) AS rank FROM {name}_c) WHERE rank <= 5),
{name}_s AS (SELECT query_id, sum(label)::INTEGER AS frauds, max(distance) FILTER (rank = 5) AS worst, (SELECT count(*) FROM {name}_p x WHERE x.query_id = y.query_id) AS rows_scanned
  FROM {name}_n y GROUP BY query_id)"""


DECIDED = "query_id, frauds, round(frauds / 5.0::DOUBLE, 1) AS fraud_score, frauds < 3 AS approved, mode::INTEGER AS mode, rows_scanned"

"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Words are counted once. Targets share a total by weight, none above a multiple of its source's size.
The total is dealt in blocks of equal size: each goes to the source with the highest quotient
target / (2 * seats + 1). A source's seats are dealt to its shards in the same way, by shard size.
In a shard the documents stand in a seeded order as one stream of words, cut into blocks; a seeded
draw picks as many blocks as the quota says, all of them once before any a second time.

Seats aren't dealt one by one: at a divisor where rounding gives too few seats all of those are
due, and only the quotients between that and a divisor that gives too many are ranked, at most a few
for each source or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from nearvote.llm.common import filled, marked, table

#: Words in a block.
BLOCK = 32
#: Words in a shard, about; a source has MOST_SHARDS at most.
SHARD_WORDS, MOST_SHARDS = 1 << 16, 4096
#: Up to so many sources their table is broadcast: under 10 MB.
FEW_SOURCES = 50_000
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def key_of(source: str) -> Column:
    """A string that isn't null and sorts as the sources do, null last."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source)))


def seeded(seed: int, *parts: Column) -> Column:
    """Hex digits that put rows into a seeded order, the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def targets(sources: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """sources: key, source_size. Adds total and target: a level times the weight, or most times the size if that is less.

    The level is what makes the targets add up to `total`, share times all sizes: sources are filled in
    the order in which they reach their bound. There is a row for each source, and one task ranks them.
    """
    order, by_reach, every = W.orderBy("key"), W.orderBy("reach", "key"), W.partitionBy()
    before = by_reach.rowsBetween(W.unboundedPreceding, -1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    return (
        sources.withColumns({"weight": weight, "bound": F.col("source_size") * F.lit(float(most))})
        .withColumns({"reach": F.col("bound") / F.col("weight"), "total": F.sum("source_size").over(every) * F.lit(float(share)), "heavy": F.sum("weight").over(every)})
        # the level if all that reach their bound before this one stand at it and the rest share what is left
        .withColumns({"full": F.coalesce(F.sum("bound").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
        .withColumn("level", (F.col("total") - F.col("full")) / (F.col("heavy") - F.col("gone")))
        .withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(every), F.max("reach").over(every)))
        .select("key", "source_size", "total", F.least(F.col("level") * F.col("weight"), F.col("bound")).alias("target"))
    )


def apportioned(parties: DataFrame, group: list[str], order: str, share: str, bound: str, seats: str) -> DataFrame:
    """Deal `seats` (one number for a group) to the rows of each group by Sainte-Laguë; adds quota.

    `share` is what a row's quotients come from, `bound` the most seats it gets. Ties go to the first in `order`.
    """
    every = W.partitionBy(*group)
    rounded = lambda d: F.when(d > 0, F.floor(F.col(share) / d + 0.5)).otherwise(0).cast("long")
    n = parties.withColumns({"_sum": F.sum(share).over(every), "_half": F.count(F.lit(1)).over(every) / 2})
    # rounding at a divisor gives sum / divisor seats, more or less half a seat for each row
    few = F.when(F.col(seats) > F.col("_half"), F.col("_sum") / (F.col(seats) - F.col("_half")))
    many = F.col("_sum") / (F.col(seats) + F.col("_half"))
    n = n.withColumns({"_low": F.least(F.coalesce(rounded(few), F.lit(0).cast("long")), F.col(bound)), "_high": F.least(rounded(many) + 1, F.col(bound))})
    n = n.withColumn("_left", F.col(seats) - F.sum("_low").over(every))
    seat = n.select("*", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))).alias("_k"))
    ranked = seat.withColumn("_q", F.col(share) / (2 * F.col("_k") + 1))
    ranked = ranked.withColumn("_won", (F.col("_q").isNotNull() & (F.row_number().over(every.orderBy(F.col("_q").desc_nulls_last(), order)) <= F.col("_left"))).cast("long"))
    return ranked.groupBy(*parties.columns, "_low").agg(F.sum("_won").alias("_won")).withColumn("quota", F.col("_low") + F.col("_won")).drop("_low", "_won")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: of documents (id, source, size, source_size, target, taken), of the blocks that are taken, and of what is repeated.

    The second has id, key (of the source), size, copy, pass, begin, length: that the words [begin, begin
    + length) of a document are taken for the first, second, ... time; pieces of one block each. The
    third has id, key and size where several rows have them alike.

    Null text has no words; a null source is a source of its own, the last in order. A source of no words
    has target 0, a document of no words has taken 0. Rows repeated under one id are documents of their
    own, told apart by `copy` where source and size are also alike; null ids are allowed. An empty table
    gives no rows. Other columns don't matter. Each source's taken words differ from its target by about
    a block, and no document is taken more than `most` times. Reruns agree.
    """
    rows = docs.select(F.col(id_col).alias("id"), key_of(source_col).alias("key"), words_of(filled(text_col)).alias("size"))
    rows = rows.groupBy("id", "key", "size").agg(F.count(F.lit(1)).alias("copies")).checkpoint()

    sources = targets(rows.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), share, most, weights)
    sources = sources.withColumns({"source_bound": (F.ceil(F.col("source_size") / block) * most).cast("long"), "seats": F.floor(F.col("total") / block + 0.5).cast("long")})
    sources = apportioned(sources, [], "key", "target", "source_bound", "seats").withColumnRenamed("quota", "source_quota")
    shards = F.greatest(F.least(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(MOST_SHARDS)), F.lit(1)).cast("long")
    sources = sources.select("key", "source_size", "target", "source_quota", shards.alias("shards")).checkpoint()
    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)

    each = rows.select("id", "key", "size", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).join(sources, "key")
    each = each.withColumn("order", seeded(seed, F.col("id"), F.col("copy")))
    each = each.withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("shards"))

    by_shard = each.filter("size > 0").groupBy("key", "shard", "source_quota").agg(F.sum("size").alias("words"))
    by_shard = by_shard.withColumn("blocks", F.ceil(F.col("words") / block).cast("long")).withColumn("shard_bound", F.col("blocks") * most)
    quotas = apportioned(by_shard, ["key"], "shard", "words", "shard_bound", "source_quota").select("key", "shard", "blocks", "quota")

    # from here on all is done where (key, shard) is: one exchange of narrow rows
    shard = W.partitionBy("key", "shard")
    placed = each.filter("size > 0").withColumn("end", F.sum("size").over(shard.orderBy("order", "id", "copy"))).withColumn("begin", F.col("end") - F.col("size"))
    placed = placed.join(quotas, ["key", "shard"])
    pieces = placed.select("*", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    drawn = F.dense_rank().over(shard.orderBy(seeded(seed, F.col("key"), F.col("shard"), F.col("block")), "block"))
    pieces = pieces.withColumns({
        "from": F.greatest("begin", F.col("block") * block), "to": F.least("end", (F.col("block") + 1) * block),
        "times": F.floor(F.col("quota") / F.col("blocks")) + (drawn <= F.col("quota") % F.col("blocks")).cast("long"),
    })

    document = ["key", "shard", "order", "id", "copy", "size", "source_size", "target"]
    taken = pieces.groupBy(*document).agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).cast("long").alias("taken"))
    taken = taken.unionByName(each.filter("size = 0").select(*document, F.lit(0).cast("long").alias("taken")))
    result = taken.select(F.col("id").alias(id_col), F.when(F.col("key") != "1", F.substring("key", 2, 1 << 30)).alias(source_col), "size", "source_size", "target", "taken")
    blocks = pieces.filter("times > 0").select(
        F.col("id").alias(id_col), "key", "size", "copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("pass"),
        (F.col("from") - F.col("begin")).alias("begin"), (F.col("to") - F.col("from")).alias("length"),
    )
    return result, blocks, rows.filter("copies > 1").select(F.col("id").alias(id_col), "key", "size")


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **how) -> DataFrame:
    """The mix itself: rows of `docs`, each with the words that are taken for the first time, and again for the second.

    A document of which all words are taken keeps its text as it is; else the text is what the blocks
    hold, with the white space between their words, and `chars_col`, if there is one, its length. A
    document of which no word is taken isn't there. Other columns stay.
    """
    _, blocks, repeated = mixed(docs, id_col, text_col, source_col, **how)
    by = ["_mix_id", "_mix_key", "_mix_size"]
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("-")).alias("_mix_id")
    takes = blocks.select(ident, F.col("key").alias("_mix_key"), F.col("size").alias("_mix_size"), F.col("copy").alias("_mix_copy"), "pass", F.struct("begin", "length").alias("piece"))
    takes = takes.groupBy(*by, "_mix_copy", "pass").agg(F.array_sort(F.collect_list("piece")).alias("_mix_pieces"), F.sum("piece.length").alias("_mix_words")).drop("pass")

    # only rows that are alike in id, source and size are numbered, so other texts go to one shuffle only
    rows = docs.select("*", ident, key_of(source_col).alias("_mix_key"), words_of(filled(text_col)).alias("_mix_size"))
    lone, nth = F.lit(1).cast("long"), F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(text_col))).cast("long")
    alike = repeated.select(ident, F.col("key").alias("_mix_key"), F.col("size").alias("_mix_size")).checkpoint()
    if alike.isEmpty():
        rows = rows.withColumn("_mix_copy", lone)
    else:
        both = marked(rows, alike, "_mix_alike")
        rows = both.filter("not _mix_alike").withColumn("_mix_copy", lone).unionAll(both.filter("_mix_alike").withColumn("_mix_copy", nth))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    # the array of words is bound to a name, so it is made once for a row and not once for each piece
    cut = lambda w: F.flatten(F.transform("_mix_pieces", lambda p: F.slice(w, (p["begin"] + 1).cast("int"), p["length"].cast("int"))))
    part = F.array_join(F.get(F.transform(F.array(words), cut), F.lit(0)), "")
    text = F.when(F.col("_mix_words") == F.col("_mix_size"), F.col(text_col)).otherwise(F.regexp_replace(part, r"^[\x20\x09-\x0D]+", ""))
    found = rows.join(takes, [*by, "_mix_copy"]).withColumn(text_col, text)
    if chars_col in docs.columns:
        found = found.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return found.select(*docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _, _ = mixed(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH doc AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
row AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key, size) AS copy FROM doc),
s1 AS (SELECT key, sum(size)::BIGINT AS source_size FROM doc GROUP BY key),
s2 AS (SELECT *, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)}] AS weight, source_size * 2::DOUBLE AS bound FROM s1),
s3 AS (SELECT *, bound / weight AS reach, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total, sum(weight) OVER () AS heavy FROM s2),
s4 AS (SELECT *, (total - coalesce(sum(bound) OVER b, 0)) / (heavy - coalesce(sum(weight) OVER b, 0)) AS level FROM s3
       WINDOW b AS (ORDER BY reach, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, least(coalesce(max(CASE WHEN level <= reach THEN level END) OVER (), max(reach) OVER ()) * weight, bound) AS target,
       2 * ceil(source_size / {BLOCK}.0)::BIGINT AS top, floor(total / {BLOCK} + 0.5)::BIGINT AS seats FROM s4),
s6 AS (SELECT * EXCLUDE (k), row_number() OVER (ORDER BY target / (2 * k + 1) DESC, key) <= seats AS won
       FROM s5, (SELECT unnest(generate_series(0, coalesce((SELECT max(top) FROM s5), 0))) AS k) WHERE k < top AND k <= target / {BLOCK} + 30),
s7 AS (SELECT s5.*, coalesce(q, 0) AS source_quota, greatest(1, least(ceil(s5.source_size / {SHARD_WORDS}.0), {MOST_SHARDS}))::BIGINT AS shards
       FROM s5 LEFT JOIN (SELECT key, count(*) FILTER (won) AS q FROM s6 GROUP BY key) USING (key)),
e AS (SELECT row.*, source_size, target, source_quota, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || copy) AS o, shards FROM row JOIN s7 USING (key)),
e2 AS (SELECT *, ('0x' || substr(o, 1, 8))::BIGINT % shards AS shard FROM e),
h1 AS (SELECT key, shard, source_quota, sum(size)::BIGINT AS words, ceil(sum(size) / {BLOCK}.0)::BIGINT AS blocks
       FROM e2 WHERE size > 0 GROUP BY key, shard, source_quota),
h2 AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY key ORDER BY words / (2 * k + 1) DESC, shard) <= source_quota AS won
       FROM h1, (SELECT unnest(generate_series(0, coalesce((SELECT 2 * max(blocks) FROM h1), 0))) AS k) WHERE k < 2 * blocks),
h3 AS (SELECT key, shard, blocks, count(*) FILTER (won) AS quota FROM h2 GROUP BY key, shard, blocks),
p AS (SELECT e2.*, sum(size) OVER (PARTITION BY key, shard ORDER BY o, doc_id, copy)::BIGINT AS stop FROM e2 WHERE size > 0),
b AS (SELECT p.*, blocks, quota, unnest(generate_series((stop - size) // {BLOCK}, (stop - 1) // {BLOCK})) AS block FROM p JOIN h3 USING (key, shard)),
t AS (SELECT *, least(stop, (block + 1) * {BLOCK}) - greatest(stop - size, block * {BLOCK}) AS length,
      quota // blocks + (dense_rank() OVER (PARTITION BY key, shard ORDER BY md5('{SEED}:' || key || ':' || shard || ':' || block), block) <= quota % blocks)::BIGINT AS times FROM b)
SELECT doc_id, size, source_size, target, sum(length * times)::BIGINT AS taken FROM t GROUP BY key, shard, o, copy, doc_id, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM e2 WHERE size = 0
"""

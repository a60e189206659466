"""Hard negatives by a search in two trees: over anchors and over candidates.

A tree splits its points at the means of the dimensions that vary most, level by level over all points, and
keeps of each node a box and a ball around its points. A pair of nodes bounds the inner product of any two
of their points from both sides; a pair that can't hold what any anchor of its group still wants is dropped
with all that is below it. What is left of leaves is scored exactly, in integers. Each leaf of anchors
first scores one leaf of candidates that it finds by going down greedily, and what that gives bounds the rest.

Points that are alike (same label, same vector) are reduced first: anchors to one, candidates to the first
few by id, since more of them can't be among the answers. So no group of copies is compared with itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from nearvote.llm.common import let_go, stored, table

#: Anchors and candidates of a leaf, at most; where points can't be told apart or the tree ends, of a block of a leaf, about.
GROUP, LEAF = 64, 512
#: Dimensions at whose means a node is split, at most, and levels of a tree.
BITS, DEPTH = 6, 10
#: Nodes of a level that are broadcast: with 64 dimensions, 4 MB.
FEW_NODES = 2048
#: Blocks of anchors that meet a block of candidates in one task.
MEETING = 64
LEAST, MOST = -(2**63) + 1, 2**63 - 1
#: An answer: rows of a different label whose score is from LOW to HIGH percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


def _sum(of: Column) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda total, x: total + x)


def tree(points: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and the leaves' points (rid, node, block), as in `grown`."""
    nodes, leaves, _ = grown(points, leaf)
    return nodes, leaves.select("rid", "node", "block")


def grown(points: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, int]:
    """points: rid, root, v and more. Nodes (node, size, blocks, center, radius, low, high, leaf, next), the leaves' points (node, block, and all but root) and how many levels there are.

    Each value of `root` has a tree of its own. A node is a struct of root and path, six bits a level. `next` has
    a node's children, of a leaf the leaf itself, so to go down takes no join. `one` is the same for all nodes.
    """
    own = [c for c in points.columns if c != "root"]
    held = points.select(*own, F.struct("root", F.lit(1).cast("long").alias("path")).alias("node"))
    nodes, levels = [], []
    for depth in range(DEPTH):
        summary = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(array_to_vector(F.col("v").cast("array<double>")))
        of = held.groupBy("node").agg(summary.alias("s"))
        of = of.select("node", F.col("s.count").alias("size"), *[vector_to_array(F.col(f"s.{x}")).alias(x) for x in ("mean", "variance", "min", "max")])
        wide = F.filter(
            F.transform("variance", lambda x, i: F.struct((-x).alias("order"), i.alias("dim"), F.greatest(F.least(F.get("mean", i), F.get("max", i) - 0.5), F.get("min", i)).alias("at"), (F.get("max", i) > F.get("min", i)).alias("varies"))),
            lambda x: x["varies"],
        )
        bits = F.when((F.col("size") <= leaf) | F.lit(depth == DEPTH - 1), 0).otherwise(F.least(F.lit(BITS), F.ceil(F.log2(F.col("size") / leaf)))).cast("int")
        of = of.withColumn("split", F.slice(F.array_sort(wide), F.lit(1), bits))
        of = of.select("node", "size", F.transform("mean", F.rint).alias("center"), F.col("min").alias("low"), F.col("max").alias("high"), "split", (F.size("split") == 0).alias("leaf")).checkpoint()
        near = of.select("node", "center", "split", "leaf", "size")
        side = F.aggregate("split", F.lit(0).cast("long"), lambda n, x: n * 2 + F.when(F.get("v", x["dim"]) > x["at"], 1).otherwise(0))
        apart = _sum(F.zip_with("v", "center", lambda x, c: (x - c) * (x - c)))
        n = of.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("leaf")).alias("open")).first()
        held = held.join(F.broadcast(near) if n["nodes"] <= FEW_NODES else near, "node")
        held = held.select(*own, "node", "leaf", "size", (F.col("node.path") * (1 << BITS) + side).alias("child"), apart.alias("apart")).checkpoint()
        nodes.append(of.drop("split"))
        levels.append(held)
        if not n["open"]:
            break
        held = held.filter("not leaf").select(*own, F.struct("node.root", F.col("child").alias("path")).alias("node"))
    every = reduce(DataFrame.unionByName, levels)
    below = every.groupBy("node").agg(F.sqrt(F.max("apart")).alias("radius"), F.collect_set(F.when(~F.col("leaf"), F.col("child"))).alias("kids"))
    blocks = F.ceil(F.col("size") / leaf).cast("int")
    kids = F.transform("kids", lambda c: F.struct(F.col("node.root").alias("root"), c.alias("path")))
    made = reduce(DataFrame.unionByName, nodes).join(below, "node").withColumns({"next": F.when(F.col("leaf"), F.array("node")).otherwise(kids), "blocks": blocks, "one": F.lit(0)})
    return made.drop("kids").checkpoint(), every.filter("leaf").select(*own, "node", F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("block")), len(levels)


def greedy(groups: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """groups: a, a_blocks, center, start (a node), target. a, b, a_blocks, b_blocks: one leaf of each group's tree, reached by the child whose center's product is nearest to the target, or largest if that is null."""
    known = nodes.select(F.col("node").alias("b"), F.col("center").alias("bc"), "next", F.col("blocks").alias("b_blocks"))
    at = groups.select("a", "a_blocks", F.col("center").alias("ac"), "target", F.array("start").alias("next"))
    product = _sum(F.zip_with("ac", "bc", lambda x, y: x * y))
    good = F.when(F.col("target").isNull(), product).otherwise(-F.abs(product - F.col("target")))
    for _ in range(levels):
        each = at.select("a", "a_blocks", "ac", "target", F.explode("next").alias("b")).join(known, "b")
        best = F.max_by(F.struct("b", "next", "b_blocks"), F.struct(good, "b.path")).alias("x")
        at = each.groupBy("a").agg(*[F.first(c).alias(c) for c in ("a_blocks", "ac", "target")], best).select("a", "a_blocks", "ac", "target", "x.*")
    return at.select("a", "b", "a_blocks", "b_blocks").checkpoint()


def upward(limits: DataFrame) -> DataFrame:
    """a, least, most of leaves: the same of all nodes above them too."""
    up = F.transform(F.sequence(F.lit(0), F.lit(DEPTH)), lambda k: F.call_function("shiftright", F.col("a.path"), (k * BITS).cast("int")))
    each = limits.select(F.col("a.root").alias("root"), F.explode(F.filter(up, lambda x: x > 0)).alias("path"), "least", "most")
    return each.groupBy(F.struct("root", "path").alias("node")).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def bounds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """What the inner product of a point of the one node and one of the other is at least and at most."""
    of = lambda name: np.stack([np.asarray(x, np.float64) for x in batch[name].to_numpy(zero_copy_only=False)]) if batch.num_rows else np.zeros((0, 1))
    a, b, al, ah, bl, bh = map(of, ("a_center", "b_center", "a_low", "a_high", "b_low", "b_high"))
    ra, rb = batch["a_radius"].to_numpy(), batch["b_radius"].to_numpy()
    long_a, long_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    middle, reach = (a * b).sum(axis=1), ra * long_b + rb * long_a + ra * rb
    corners = np.stack([al * bl, al * bh, ah * bl, ah * bh])
    slack = 1 + 1e-9 * (long_a + ra) * (long_b + rb)  # for what rounding may take
    return np.maximum(corners.min(axis=0).sum(axis=1), middle - reach) - slack, np.minimum(corners.max(axis=0).sum(axis=1), middle + reach) + slack


def descended(a_nodes: DataFrame, b_nodes: DataFrame, start: DataFrame, levels: int) -> DataFrame:
    """a, b, a_blocks, b_blocks: the pairs of leaves that may hold a score from `least` to `most` of their group (columns of a_nodes), beginning with the pairs `start`."""
    side = lambda nodes, s, *more: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("center", "radius", "low", "high", "next", "blocks")], *more)
    first, second = side(a_nodes, "a", "least", "most"), side(b_nodes, "b")
    names = ["a", "b", "a_next", "b_next", "a_blocks", "b_blocks"]

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, most = bounds(batch)
            kept = (most >= batch["least"].to_numpy()) & (least <= batch["most"].to_numpy())
            yield batch.select(names).filter(pa.array(kept))

    held = start
    for level in range(levels):
        if level:  # a pair of leaves stays as it is
            held = held.select(F.explode("a_next").alias("a"), "b_next").select("a", F.explode("b_next").alias("b")).repartition("a", "b")
        both = held.join(first, "a").join(second, "b")
        held = both.mapInArrow(keep, both.select(names).schema)
    return held.select("a", "b", "a_blocks", "b_blocks").checkpoint()


def answers(windows: DataFrame, pairs: DataFrame, points: DataFrame, k: int, same: bool) -> DataFrame:
    """class, w, score, vec_id, rid: of each window the k best points of the leaves that its leaf is paired with.

    windows: a, block, class, label, v, w, lo, hi. pairs: a, b, a_blocks, b_blocks. points: b, block, rid, vec_id, label, v. A point answers
    if its label is the same, or another, and its score from lo to hi; higher scores come first, then smaller ids.
    The windows of a leaf travel to the blocks of candidates; a block that many ask for is dealt to several tasks.
    """
    packed = windows.groupBy("a", F.col("block").alias("a_block")).agg(F.collect_list(F.struct("class", "label", "v", "w", "lo", "hi")).alias("windows"))
    salts = pairs.groupBy("b").agg(F.ceil(F.sum("a_blocks") / MEETING).cast("int").alias("salts"))
    asked = pairs.join(salts, "b").join(packed, "a").withColumn("salt", F.pmod(F.xxhash64("a", "a_block"), "salts").cast("int"))
    left = asked.select("b", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)).alias("block"), "salt", "windows")
    right = points.join(salts, "b").select(F.col("b").alias("of"), F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("of_salt"), "rid", "vec_id", "label", "v")
    made = "class long, w long, score long, vec_id long, rid long"

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = [best(pc.list_flatten(x), there, k, same) for x in asked["windows"].chunks if len(x)] if there.num_rows and asked.num_rows else []
        names = [x.split()[0] for x in made.split(", ")]
        return pa.concat_tables(out) if out else pa.schema([(n, pa.int64()) for n in names]).empty_table()

    found = left.groupBy("b", "block", "salt").cogroup(right.groupBy("of", "of_block", "of_salt")).applyInArrow(meet, made)
    place = F.row_number().over(W.partitionBy("class", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def best(windows: pa.Array, there: pa.Table, k: int, same: bool) -> pa.Table:
    """Of some windows the k best of a block."""
    of = lambda name: windows.field(name)
    classes, at, own = np.unique(of("class").to_numpy(), return_index=True, return_inverse=True)
    matrix = lambda column: np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    x, y = matrix(of("v").take(pa.array(at))), matrix(there["v"].combine_chunks())
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] >= 2**53:  # doubles don't hold such products
        x, y = (np.array(c.to_pylist(), object) for c in (of("v").take(pa.array(at)), there["v"]))
    scores = (x @ y.T)[own]
    ids = there["vec_id"].to_numpy() if there["vec_id"].null_count == 0 else there["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    labels = pa.chunked_array([of("label"), *there["label"].chunks]).combine_chunks().dictionary_encode()
    labels = labels.indices.to_numpy()
    alike = labels[: len(windows)][:, None] == labels[len(windows) :][None, :]
    hit = (alike == same) & (scores >= of("lo").to_numpy()[:, None]) & (scores <= of("hi").to_numpy()[:, None])
    w, r = np.nonzero(hit)
    score = scores[w, r].astype(np.int64)
    order = np.lexsort((there["rid"].to_numpy()[r], ids[r], -score, w))
    place = np.arange(len(w)) - np.searchsorted(w, w, "left")  # w ascends
    kept = order[place < k]
    w, r, score = w[kept], r[kept], score[kept]
    return pa.table({"class": of("class").to_numpy()[w], "w": of("w").to_numpy()[w], "score": score, "vec_id": there["vec_id"].take(pa.array(r)), "rid": there["rid"].take(pa.array(r))}).combine_chunks()


def search(windows: DataFrame, a_nodes: DataFrame, b_nodes: DataFrame, points: DataFrame, levels: tuple[int, int], roots: Column, k: int, same: bool, target: Column) -> DataFrame:
    """Two steps: a leaf of candidates for each leaf of anchors, then all pairs of leaves that may beat what that gave."""
    root = F.struct(roots.alias("root"), F.lit(1).cast("long").alias("path"))
    leaves = a_nodes.filter("leaf").select(F.col("node").alias("a"), F.col("blocks").alias("a_blocks"), "center", root.alias("start")).join(windows.groupBy("a").agg(target.alias("target")), "a")
    first = answers(windows, greedy(leaves, b_nodes, levels[1]), points, k, same)
    floor = first.groupBy("class", "w").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    windows = windows.join(floor, ["class", "w"], "left").withColumn("lo", F.greatest("lo", "floor")).drop("floor").checkpoint()
    a_nodes = a_nodes.join(upward(windows.select("a", F.col("lo").alias("least"), F.col("hi").alias("most"))), "node").checkpoint()
    start = a_nodes.filter("node.path = 1").select(F.col("node").alias("a"), root.alias("b"))
    return answers(windows, descended(a_nodes, b_nodes, start, max(levels)), points, k, same)


def mined(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v (array of integers), anchor (boolean). A score is the inner product with the
    anchor. The positives of an anchor are the first other rows of its label by score, then smaller id; for
    each, the first rows of another label whose score is from low to high percent of the positive's.
    Rows without label, vector or components take no part; shorter vectors are filled with zeros. A null id
    comes last among equal scores and is no anchor's; rows repeated under one id are rows of their own, an anchor's
    repetition may be its positive, and each repetition of an anchor gives its rows. An empty table gives
    none. Other columns don't matter.
    """
    rows = rows.filter("label is not null and v is not null and not exists(v, x -> x is null)")
    dims = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    v = F.concat(F.col("v").cast("array<long>"), F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    rows = rows.select("vec_id", "label", v.alias("v"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("rid"))
    rows = stored(rows, "vectors")
    anchors = rows.filter("anchor")
    classes = anchors.groupBy("label", "v").agg(F.min("rid").alias("rid")).checkpoint()
    of_class = W.partitionBy("label", "v").orderBy(F.asc_nulls_last("vec_id"), "rid")
    points = rows.withColumn("n", F.row_number().over(of_class)).filter(F.col("n") <= max(positives + 1, negatives)).drop("n", "anchor").checkpoint()

    a_nodes, a_leaves, a_levels = grown(classes.select("rid", F.col("label").alias("root"), "label", "v"), GROUP)
    asking = a_leaves.select(F.col("node").alias("a"), "block", F.col("rid").alias("class"), "label", "v")
    placed = lambda leaves: leaves.select(F.col("node").alias("b"), "block", "rid", "vec_id", "label", "v")

    p_nodes, p_leaves, p_levels = grown(points.withColumn("root", F.col("label")), LEAF)
    whole = asking.withColumns({"w": F.lit(0).cast("long"), "lo": F.lit(LEAST), "hi": F.lit(MOST)})
    # one more than asked for, since the anchor itself is among them
    found = search(whole, a_nodes, p_nodes, placed(p_leaves), (a_levels, p_levels), F.col("node.root"), positives + 1, True, F.first(F.lit(None).cast("double"))).checkpoint()
    del whole, p_nodes, p_leaves
    let_go(rows.sparkSession)

    n_nodes, n_leaves, n_levels = grown(points.withColumn("root", F.lit(0)), LEAF)
    # so many percent of a score, rounded down or up, without its product
    share = lambda percent, up: F.expr(f"((score - pmod(score, 100)) div 100) * {percent} + (pmod(score, 100) * {percent} + {up}) div 100")
    asked = found.select("class", "score").distinct().select("class", F.col("score").alias("w"), share(low, 99).alias("lo"), share(high, 0).alias("hi")).filter("lo <= hi")
    against = search(asking.join(asked, "class").checkpoint(), a_nodes, n_nodes, placed(n_leaves), (a_levels, n_levels), F.col("one"), negatives, False, F.avg("hi"))
    against = against.groupBy("class", F.col("w").alias("positive_score")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("negatives"))

    own = found.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("rank", "rid", "vec_id", "score"))).alias("found"))
    each = anchors.join(classes.withColumnRenamed("rid", "class"), ["label", "v"]).select("vec_id", "rid", "class").join(own, "class")
    each = each.select(F.col("vec_id").alias("anchor_id"), "class", F.explode(F.slice(F.filter("found", lambda x: x["rid"] != F.col("rid")), 1, positives)).alias("p"))
    each = each.select("anchor_id", "class", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score")).join(against, ["class", "positive_score"])
    return each.select("anchor_id", "positive_id", "positive_score", F.explode("negatives").alias("x")).select(
        "anchor_id", "positive_id", F.col("x.rank").cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return mined(rows.select("vec_id", label.alias("label"), v.alias("v"), (F.col("vec_id") % 50 == 0).alias("anchor")))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

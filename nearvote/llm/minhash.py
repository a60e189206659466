"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set is its distinct shingles of five words. 128 MinHash samples give 32 bands of 4, in which
documents that are alike meet, and an odd sketch: the samples folded into 512 parity bits. The number
of bits in which two sketches differ bounds how many samples differ, and drops pairs that are surely
not alike; what remains is confirmed on the full sets.

Equal sets count once. In each bucket all meet a few leaders, which links most groups without all
pairs. Then, in buckets that still hold several components, members outside the largest one meet all
members whose component is another, so no pair of a bucket that could join two components is left out.
There a family of texts that are only nearly alike enough has many pairs; a second sketch, of 2048
samples in 8192 bits, drops those below a similarity of about 0.7 inside the join.
The chance that a pair at the limit meets in no band is 5e-6, that its sketches differ too much 1e-6 each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearvote.llm.common import by_size, filled, let_go, marked, removed, stored, table
from nearvote.llm.components import components

SHINGLE = 5
SAMPLES, BANDS, BITS = 128, 32, 512
#: Samples and bits of the second sketch.
FINE_SAMPLES, FINE_BITS = 2048, 8192
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Leaders of a bucket: the first in as many orders of ids.
LEADERS = 8
#: Members of a bucket that stand in one task when components of a bucket meet.
SALT_ROWS = 1024
#: Pairs of one document that stand in one task when sets are compared; up to so many such documents their list is broadcast: under 2 MB.
HOT_PAIRS, FEW_HOT = 512, 100_000

_MULTIPLIERS = np.array([int.from_bytes(hashlib.blake2b(b"minhash %d" % i, digest_size=8).digest(), "little") | 1 for i in range(SAMPLES)], np.uint64)
_PLACES = np.array([int.from_bytes(hashlib.blake2b(b"shingle %d" % i, digest_size=8).digest(), "little") | 1 for i in range(SHINGLE + 1)], np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text: of five words, or of all if there are fewer. A-Z are lowered."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64) * _PLACES[SHINGLE]
    for k in range(size):
        h += mixed(w[k : k + n] + np.uint64(k)) * _PLACES[k]
    return np.unique(mixed(h))


def samples(of: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    found = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 19) // len(multipliers))
    for i in range(0, len(of), step):
        found = np.minimum(found, (multipliers[:, None] * of[None, i : i + step]).min(axis=1))
    return found


def bands(of: np.ndarray) -> np.ndarray:
    """A key for each band."""
    rows = of.reshape(BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mixed(key * _A + rows[:, k])
    return key


def odd_sketch(of: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity of how many samples fall on each bit, as 64-bit words."""
    at = mixed(of + np.arange(1, len(of) + 1, dtype=np.uint64) * _B) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


@lru_cache
def most_bits(percent: int = PERCENT, samples: int = SAMPLES, bits: int = BITS, miss: float = 1e-6) -> int:
    """In how many bits the sketches of a pair of this similarity differ at most, but for a chance of `miss`.

    Of the samples a binomial number differ; each of these turns over one bit for either set.
    """
    differ = np.zeros(samples + 1)
    differ[0] = 1.0
    for _ in range(samples):
        differ = differ * (percent / 100) + np.concatenate(([0.0], differ[:-1])) * (1 - percent / 100)
    odd, chance, at = np.zeros(bits + 1), np.zeros(bits + 1), np.arange(bits + 1)
    odd[0] = 1.0
    for d in range(samples + 1):
        chance += differ[d] * odd
        for _ in range(2):
            up, down = odd * (bits - at) / bits, odd * at / bits
            odd = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    return int(np.flatnonzero(np.cumsum(chance) >= 1 - miss)[0])


def key_of(of: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(of.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n (set size), key (of the set), bands array<long>, odd array<long>; both empty for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in by_size(batches, "text", 4 << 20):
            n, keys, band, odd = [], [], [], []
            for text in batch["text"].to_pylist():
                of = shingles(text)
                s = samples(of) if len(of) else None
                n.append(len(of))
                keys.append(key_of(of))
                band.append(none if s is None else bands(s).view(np.int64))
                odd.append(none if s is None else odd_sketch(s).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), filled(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, text_hash long, n long, key binary, bands array<long>, odd array<long>")


def text_hash(text_col: str = "text") -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(filled(text_col))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are alike. Texts are read again, for the documents of the pairs only."""
    of = lambda s: nodes.select(F.col("node").alias(s), F.col("rep").alias(f"{s}_id"), F.col("key").alias(f"{s}_key"))
    pairs = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").checkpoint()
    let_go(docs.sparkSession)
    ids = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id"))).distinct().checkpoint()

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", 4 << 20):
            found = [shingles(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([key_of(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "key", "set"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                alike.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    held = of_ids(docs, ids, id_col, text_col).mapInArrow(sets, "id long, key binary, set binary")  # and some more, which no pair asks for
    both = with_sets(with_sets(pairs, hot_ids(pairs, "b"), held, "b"), hot_ids(pairs, "a"), held, "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long").distinct().checkpoint()


def hot_ids(pairs: DataFrame, side: str) -> DataFrame:
    """id, key and salts: the documents of many pairs, and to how many tasks each one's pairs are dealt."""
    counted = pairs.groupBy(F.col(f"{side}_id").alias("id"), F.col(f"{side}_key").alias("key")).count().filter(F.col("count") > HOT_PAIRS)
    hot = counted.select("id", "key", F.ceil(F.col("count") / HOT_PAIRS).cast("int").alias("salts")).checkpoint()
    return F.broadcast(hot) if hot.count() <= FEW_HOT else hot


def with_sets(pairs: DataFrame, hot: DataFrame, held: DataFrame, side: str) -> DataFrame:
    """`pairs` with the set of `side`, by id, key and salt."""
    salts, of = F.coalesce("salts", F.lit(1)), {"id": f"{side}_id", "key": f"{side}_key"}
    left = pairs.join(hot.withColumnsRenamed(of), list(of.values()), "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts).cast("int")).drop("salts")
    right = held.join(hot, list(of), "left").select(*[F.col(k).alias(v) for k, v in of.items()], F.col("set").alias(f"set_{side}"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return left.join(right, [*of.values(), "salt"]).drop("salt", *of.values())


def of_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the rows whose ids are in `ids` (a checkpoint), and of a few others that the filter lets pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    return marked(rows, ids, "wanted").filter("wanted").drop("wanted")


def finely_sketched(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and fine array<long>, the second sketch, of `nodes` (node, rep, key). Their texts are read again."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = mixed(np.arange(1, FINE_SAMPLES + 1, dtype=np.uint64) * _B) | np.uint64(1)
        for batch in by_size(batches, "text", 4 << 20):
            sets = [shingles(t) for t in batch["text"].to_pylist()]
            found = [odd_sketch(samples(of, multipliers), FINE_BITS).view(np.int64) if len(of) else np.zeros(0, np.int64) for of in sets]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([key_of(x) for x in sets], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["rep", "key", "fine"])

    nodes = nodes.select("node", "rep", "key").checkpoint()
    found = of_ids(docs, nodes.select(F.col("rep").alias("id")).distinct().checkpoint(), id_col, text_col).mapInArrow(work, "rep long, key binary, fine array<long>")
    return found.join(nodes, ["rep", "key"]).groupBy("node").agg(F.first("fine").alias("fine"))


def may_be_alike(percent: int) -> Column:
    """Of two rows with n and odd: their sizes and their sketches allow a link."""
    words = [F.bit_count(F.get("odd", F.lit(k)).bitwiseXOR(F.get("other_odd", F.lit(k)))) for k in range(BITS // 64)]
    sizes = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent
    return sizes & (reduce(add, words) <= most_bits(percent))


def meet_first(band: str = "band") -> Column:
    """Of two rows with bands that meet in this band: they meet in none before."""
    before = [(F.col(band) > k) & (F.get("bands", F.lit(k)) == F.get("other_bands", F.lit(k))) for k in range(BANDS - 1)]
    return ~reduce(or_, before)


def finely_alike(percent: int) -> Column:
    apart = F.aggregate(F.zip_with("fine", "other_fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return apart <= most_bits(percent, FINE_SAMPLES, FINE_BITS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, text_hash, n_shingles, component_id (the smallest id that links reach, its own included) and kept (that is its own).

    Null text counts as empty. Documents without words link with nothing. Documents of equal sets are in
    one component, also under a null id, which is never the smallest; of a set that only null ids have,
    component_id is null and all stay. Rows repeated under one id have a row each, and if their texts differ,
    each is linked by its own text; `text_hash` (of `text_hash()`) tells them apart. An empty table gives no
    rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    sketches = stored(sketched(docs, id_col, text_col), "sketches")
    # a node for each set: a document with an id stands for it
    of_key = sketches.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", "odd")])
    nodes = stored(of_key.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    all_rows = stored(sketches.select("doc_id", "text_hash", "n", "key"), "sets")
    removed(sketches)

    # orders of nodes: exclusive or with a mask is a bijection, so the least value gives its node back
    masks = F.array(*[F.lit(int(m) >> 2) for m in _MULTIPLIERS[:LEADERS]])
    met = nodes.select("node", F.posexplode("bands").alias("band", "bucket")).withColumn("mask", F.get(masks, F.col("band") % LEADERS))
    buckets = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min(F.col("node").bitwiseXOR(F.col("mask"))).alias("least")).filter("members > 1")
    buckets = buckets.checkpoint()
    shared = met.join(buckets, "bucket").select("bucket", "band", "members", "node", F.col("least").bitwiseXOR(F.col("mask")).alias("leader"))
    shared = shared.checkpoint()
    let_go(spark)

    side = lambda s, other="": nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{other}{c}") for c in ("n", "odd")])
    stars = shared.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    stars = stars.join(side("a"), "a").join(side("b", "other_"), "b").filter(may_be_alike(percent)).select("a", "b").checkpoint()
    first = components(confirmed(stars, nodes, docs, id_col, text_col, percent)).checkpoint()
    let_go(spark)

    # buckets of three and more that several components share: all pairs of two have been compared
    placed = shared.filter("members > 2").join(first, "node", "left").select("bucket", "band", "members", "node", F.coalesce("component", "node").alias("component"))
    counted = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = counted.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count(F.lit(1)).alias("number")).filter("number > 1").drop("number")
    largest = largest.checkpoint()  # so the join has an exchange on either side, and a hot bucket can be split
    rest = placed.join(largest, "bucket").checkpoint()
    some = nodes.join(rest.select("node").distinct(), "node", "left_semi")
    fine = finely_sketched(docs, some, id_col, text_col)
    rest = stored(rest.join(nodes.select("node", "n", "bands", "odd"), "node").join(fine, "node"), "shared-buckets")
    let_go(spark)
    salts = F.ceil(F.col("members") / SALT_ROWS).cast("int")
    sides = ["component", "n", "bands", "odd", "fine"]
    few = rest.filter("component <> largest").select("bucket", "band", "node", *sides, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    every = rest.select("bucket", F.col("node").alias("other"), *[F.col(c).alias(f"other_{c}") for c in sides], F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
    across = few.join(every, ["bucket", "salt"]).filter((F.col("component") != F.col("other_component")) & may_be_alike(percent) & meet_first() & finely_alike(percent))
    across = across.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct().join(stars, ["a", "b"], "left_anti").checkpoint()
    removed(rest)
    second = confirmed(across, nodes, docs, id_col, text_col, percent)
    let_go(spark)

    def named(pairs: DataFrame, column: str) -> DataFrame:
        return pairs.join(first.withColumnsRenamed({"node": column, "component": "c"}), column, "left").withColumn(column, F.coalesce("c", column)).drop("c")

    joined = components(named(named(second, "a"), "b"))
    final = first.unionByName(second.select(F.col("a").alias("node")).unionByName(second.select(F.col("b").alias("node"))).distinct().join(first, "node", "left_anti").withColumn("component", F.col("node")))
    final = final.join(joined.select(F.col("component").alias("joined"), F.col("node").alias("component")), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))

    of_node = nodes.select("node", "key", "rep").join(final, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component")).checkpoint()
    smallest = of_node.groupBy("component").agg(F.min("rep").alias("least"))
    of_set = of_node.join(smallest, "component").select("key", "least")
    lone = F.when(F.col("n") > 0, F.col("key")).otherwise(F.concat(F.lit(b"-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    result = all_rows.select("doc_id", "text_hash", "n", lone.alias("key")).join(of_set, "key", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return result.select(F.col("doc_id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

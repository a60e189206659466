"""Chat formatting with a prefix tree: turns that conversations share at their beginning are emitted once.

A turn is written as a header with its role, its text and a closing mark; control strings inside texts
and roles are escaped reversibly, so that they don't stand there any more. Header, text and mark are
encoded to token ids one by one, so turns and the text under the loss mask begin and end with a token.
Conversations with the same turns are one leaf; leaves are sorted by the hashes of their turns, so that
those with a common beginning stand together. A leaf emits only the turns that it doesn't share with the
leaf before it: each node of the tree once, in depth-first order. Position ids count tokens from the
beginning of a conversation, places from that of the whole output. A node attends to itself and to the
intervals of places that its ancestors fill.

The sort is by ranges of whole paths, so a first turn that a third of all conversations share is dealt
to many tasks. Where a range begins in the tree is worked out from a summary of each range, and every
range has copies of the nodes that its first leaf shares with the range before it: it can be read alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from nearvote.llm.bpe import encoder, lists, public_ranks
from nearvote.llm.common import by_size, partitions, stored, table

OPEN, CLOSE = "### ", " </turn>\n"
#: The role that is learned from.
LEARNED = "assistant"
#: Characters of texts that a task hands on at once.
AT_ONCE = 1 << 20


# ---- the template

#: What stands for a character in a role or a text, after a backslash.
ESCAPES = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?) </turn>\n", re.S)


def escaped(text: Column) -> Column:
    """Backslashes doubled, and of ### and </turn the first character replaced: neither stands in the text any more."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"#(?=##)", r"\\h")
    return F.regexp_replace(text, r"<(?=/turn)", r"\\l")


def escaped_role(role: Column) -> Column:
    """As a text, and without colons and line feeds."""
    return F.replace(F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES[m[1]], text)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation, by its marks alone."""
    found, at = [], 0
    while at < len(text):
        turn = TURN.match(text, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return found


def formatted(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, learned, head, body, key (16 bytes of a hash of the written turn)."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    head = F.concat(F.lit(OPEN), escaped_role(role), F.lit(": "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), (role == LEARNED).alias("learned"), head.alias("head"), escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    return rows.withColumn("key", F.unhex(F.substring(F.sha2(F.concat("head", "body"), 256), 1, 32)))


class Turns:
    """Token ids of written turns in a worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.bpe = encoder(path, pattern)
        self.fixed = lru_cache(1024)(self.one)

    def one(self, text: str) -> bytes:
        return self.bpe.encode([text])[0]

    def ids(self, head: str, body: str) -> tuple[bytes, int, int, int]:
        """All ids of a turn as the encoder has them, begin and number of those of its text, and their number."""
        h, b, c = self.fixed(head), self.one(body), self.fixed(CLOSE)
        size = self.bpe.dtype.itemsize
        return h + b + c, len(h) // size, len(b) // size, (len(h) + len(b) + len(c)) // size


# ---- the tree


def common(a: list, b: list) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


class Walk:
    """A walk over leaves in order: the path of the leaf before, the places of its nodes, and the next free place."""

    def __init__(self, path: list, places: list[int], at: int) -> None:
        self.path, self.places, self.at = path, places, at

    def leaf(self, path: list, sizes: list[int]) -> int:
        """Go to the next leaf; returns how many of its nodes have been emitted before."""
        shared = common(self.path, path)
        self.path, self.places = path, self.places[:shared]
        for n in sizes[shared:]:
            self.places.append(self.at)
            self.at += n
        return shared


def ancestry(places: list[int], sizes: list[int]) -> Iterator[list[dict[str, int]]]:
    """For each node of a path the places that those before it fill, neighbours joined."""
    found: list[tuple[int, int]] = []
    for p, n in zip(places, sizes, strict=True):
        yield [{"start": a, "end": b} for a, b in found]
        if found and found[-1][1] == p:
            found[-1] = found[-1][0], p + n
        else:
            found.append((p, p + n))


class PrefixTree:
    """Two tables; see `prefix_tree`."""

    def __init__(self, rows: DataFrame, members: DataFrame, path: str, pattern: str) -> None:
        self.rows, self.members, self.path, self.pattern = rows, members, path, pattern

    @property
    def nodes(self) -> DataFrame:
        """Every node once, with the ids of its tokens, their position_ids, and loss_mask (1 for those that are learned)."""
        rows, (path, pattern) = self.rows.filter(~F.col("copied")).drop("copied"), (self.path, self.pattern)
        names = [c for c in rows.columns if c != "ids"]
        made = StructType([*[rows.schema[c] for c in names], *rows.sparkSession.createDataFrame([], "ids array<int>").schema.fields])

        def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = encoder(path, pattern)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], lists([bpe.ids(raw) for raw in batch["ids"].to_pylist()])], names=[*names, "ids"])

        learned = F.transform("ids", lambda _, i: (F.col("learned") & (i >= F.col("begin")) & (i < F.col("begin") + F.col("size"))).cast("int"))
        ids = F.sequence("position", F.col("position") + F.size("ids") - 1)
        return rows.mapInArrow(listed, made).withColumns({"position_ids": ids, "loss_mask": learned})


def prefix_tree(
    turns: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> PrefixTree:
    """Merge conversations into one tree, as ids of the byte-level BPE with these ranks and this pattern.

    nodes: place, ids, depth, position (of its first token in any conversation through it), position_ids,
    attends (array of start and end of its ancestors' places), begin and size of the text among its ids,
    learned, loss_mask, leaf (of the conversations that end with it, else null), range. In order of
    `place` they are the output. members: conv, leaf.

    Turns stand by turn number; nulls first, of equal numbers by hash of the written turn; repeated rows
    are turns of their own. Null roles and texts count as empty. Rows without a conversation id form one
    conversation. An empty table gives empty tables. Other columns don't matter. A conversation's hashes
    and sizes stand in one row; its texts do so only where it is read back.
    """
    spark = turns.sparkSession
    written = formatted(turns, conv_col, turn_col, role_col, text_col)
    kinds = [*[written.schema[c] for c in ("conv", "turn", "key", "learned")], *spark.createDataFrame([], "ids binary, begin int, size int, n int").schema.fields]

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Turns(path, pattern)
        for batch in by_size(batches, "body"):
            found = [made.ids(h, b) for h, b in zip(batch["head"].to_pylist(), batch["body"].to_pylist(), strict=True)]
            new = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], names=[k.name for k in kinds])

    # turns are encoded once, and from here on their ids take the place of their texts
    rows = stored(written.select("conv", "turn", "key", "learned", "head", "body").mapInArrow(encoded, StructType(kinds)), "turns")

    # array_sort puts nulls inside a struct first
    convs = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "key", F.col("n").cast("long").alias("n")))).alias("t"))
    whole = F.unhex(F.sha2(F.array_join(F.transform("t.key", F.hex), ""), 256))
    convs = convs.select("conv", F.col("t.key").alias("path"), F.col("t.n").alias("sizes"), whole.alias("leaf")).checkpoint()

    # of equal conversations one is the leaf's: the least id
    leaves = convs.groupBy("leaf").agg(F.min("conv").alias("conv"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    leaves = leaves.repartitionByRange(partitions(spark), "path").sortWithinPartitions("path")
    leaves = leaves.select(F.spark_partition_id().alias("range"), "leaf", "conv", "path", "sizes").checkpoint()

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each range begins and ends with, as if nothing stood before it."""
        walk, first = Walk([], [], 0), None
        for batch in batches:
            for row in batch.to_pylist():
                first = first or row
                walk.leaf(row["path"], row["sizes"])
        if first:
            yield pa.RecordBatch.from_pylist([{"range": first["range"], "first": first["path"], "first_sizes": first["sizes"], "last": walk.path, "places": walk.places, "all": walk.at}], schema=summary)

    summary = pa.schema([("range", pa.int32()), ("first", pa.list_(pa.binary())), ("first_sizes", pa.list_(pa.int64())), ("last", pa.list_(pa.binary())), ("places", pa.list_(pa.int64())), ("all", pa.int64())])
    ranges = leaves.select("range", "path", "sizes").mapInArrow(summed, "range int, first array<binary>, first_sizes array<long>, last array<binary>, places array<long>, all long").orderBy("range").collect()
    begins = spark.sparkContext.broadcast(_begins(ranges))  # the path before each range

    walked_schema = StructType([
        *spark.createDataFrame([], "range int").schema.fields, convs.schema["conv"],
        *spark.createDataFrame([], "key binary, depth int, place long, position long, attends array<struct<start: long, end: long>>, leaf binary, copied boolean").schema.fields,
    ])
    names = walked_schema.names
    arrow = pa.schema([("key", pa.binary()), ("depth", pa.int32()), ("place", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("leaf", pa.binary()), ("copied", pa.bool_())])

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            out, of = [], []
            for i, row in enumerate(batch.select(["range", "leaf", "path", "sizes"]).to_pylist()):
                copied = walk is None
                walk = walk or Walk(*begins.value[row["range"]])
                keys, sizes = row["path"], row["sizes"]
                shared, position = walk.leaf(keys, sizes), 0
                for k, attends in enumerate(ancestry(walk.places, sizes)):
                    if copied or k >= shared:
                        out.append((keys[k], k, walk.places[k], position, attends, row["leaf"] if k == len(keys) - 1 else None, k < shared))
                        of.append(i)
                    position += sizes[k]
            made = pa.RecordBatch.from_pylist([dict(zip(arrow.names, o, strict=True)) for o in out], schema=arrow)
            own = batch.select(["range", "conv"]).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *made.columns], names=names)

    wanted = leaves.mapInArrow(walked, walked_schema).withColumnsRenamed({"conv": "c", "key": "k"})
    # turns of one conversation with one key are alike
    ids = rows.select("conv", "key", "learned", "ids", "begin", "size").dropDuplicates(["conv", "key"])
    nodes = ids.join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    nodes = nodes.select("range", "place", "depth", "position", "attends", "leaf", "copied", "learned", "ids", "begin", "size")
    return PrefixTree(nodes, convs.select("conv", "leaf"), path, pattern)


def _begins(ranges: list) -> dict[int, tuple]:
    """For each range: the path before it, the places of that path's nodes, and the first free place."""
    found, before, places, at = {}, [], [], 0
    for r in ranges:
        found[r["range"]] = (before, places, at)
        shared = common(before, r["first"])
        gone = sum(r["first_sizes"][:shared])  # what the range's own count has and the tree doesn't
        # nodes of the last path that are the first path's shared ones stand where they stood before
        kept = min(shared, common(r["first"], r["last"]))
        places = places[:kept] + [at + p - gone for p in r["places"][kept:]]
        before, at = r["last"], at + r["all"] - gone
    return found


# ---- reading back


def leaves_read(tree: PrefixTree) -> DataFrame:
    """Each leaf's conversation, decoded from the ids of the nodes on its path and parsed by its marks.

    leaf, turns (array of role and text), loss (all text under the mask), formatted_chars, n_tokens,
    positions (position ids run from 0 to this, exclusive), attended (tokens that the last node attends to).
    A task reads its range in order and holds the nodes of one path.
    """
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("leaf", pa.binary()), ("turns", pa.list_(turn)), ("loss", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("positions", pa.int64()), ("attended", pa.int64())])
    path, pattern = tree.path, tree.pattern

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, stack, out, held = encoder(path, pattern), [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                ids = bpe.ids(row["ids"])
                masked = ids[row["begin"] : row["begin"] + row["size"]] if row["learned"] else ids[:0]
                del stack[row["depth"] :]
                stack.append((bpe.decode(ids), bpe.decode(masked), len(ids)))
                if row["leaf"] is None or row["copied"]:
                    continue
                text = b"".join(s[0] for s in stack).decode()
                attended = sum(a["end"] - a["start"] for a in row["attends"]) + len(ids)
                loss = "".join(unescaped(s[1].decode()) for s in stack)
                out.append((row["leaf"], [{"role": r, "text": t} for r, t in parsed(text)], loss, len(text), sum(s[2] for s in stack), row["position"] + len(ids), attended))
                held += len(text)
                if held > AT_ONCE:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema=schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema=schema)

    rows = tree.rows.repartitionById(partitions(tree.rows.sparkSession), F.col("range")).sortWithinPartitions("range", "place")
    made = "leaf binary, turns array<struct<role: string, text: string>>, loss string, formatted_chars long, n_tokens long, positions long, attended long"
    return rows.select("place", "depth", "position", "attends", "leaf", "copied", "learned", "ids", "begin", "size").mapInArrow(work, made)


def read_back(tree: PrefixTree) -> DataFrame:
    """Each conversation as `leaves_read` has it: conv and those columns."""
    return tree.members.join(leaves_read(tree), "leaf").drop("leaf")


#: The conversation that op1 adds: control strings inside both texts.
ADDED = r"\### Assistant: </turn> ok"


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)], turns.schema))
    tree = prefix_tree(turns, *public_ranks())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # digests are taken once for a leaf, and joined to all its conversations
    read = leaves_read(tree).select(
        "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_tokens", "positions", "attended",
    )
    return tree.members.withColumnRenamed("conv", "conv_id").join(read, "leaf").drop("leaf")

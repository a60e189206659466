"""Token ids in files: canonical length-limited Huffman codes, decoded by table in independent blocks.

A data set has three Parquet tables: `codebook` (id, length; codes follow from these), `chunks` (part,
begin, doc_ids, doc_sizes, checkpoints, n_bits, bits) and `parts` (part, start). A part holds a range of
document ids, its chunks consecutive whole documents in ascending order. `begin` counts ids from
the part's beginning, `start` those before the part. Every BLOCK ids a checkpoint gives the bit at which
the next block begins, so any block can be decoded by itself, and all of a chunk side by side.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.bpe import LONG, Kept, byte_characters, in_parts
from nearvote.llm.common import by_size, cuts_of, filled, gathered, gone_at_exit, new_path, partitions, range_of, table

#: Ids in a block; the longest code where that is long enough (see `longest_of`); ids in a chunk, about.
BLOCK, LONGEST, CHUNK = 256, 16, 1 << 18
#: Ids that are packed at once, whole blocks: what they need fits a processor's cache.
PACKED = 64 * BLOCK
END = 1


# ---- codes


def longest_of(symbols: int) -> int:
    """The longest code for so many symbols: LONGEST where all have one of that length, else two bits more than equal codes need."""
    return LONGEST if symbols <= 1 << LONGEST else (symbols - 1).bit_length() + 2


def code_lengths(counts: np.ndarray, longest: int | None = None) -> np.ndarray:
    """The code length of each symbol, 0 where the count is 0: optimal for a longest length (package-merge)."""
    symbols = np.flatnonzero(counts)
    longest = longest or longest_of(len(symbols))
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << longest:
        raise ValueError(f"{len(symbols)} symbols don't fit codes of {longest} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # at each level: sorted weights of leaves and of pairs of the level below; which entries are leaves
    levels, packed = [], np.zeros(0)
    for _ in range(longest):
        weights = np.concatenate([leaf, packed])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < len(leaf))
        weights = weights[rank]
        even = len(weights) // 2 * 2
        packed = weights[0:even:2] + weights[1:even:2]
    # from the last level down: of the entries that are taken, leaves count once and pairs open two entries below
    take = 2 * len(leaf) - 2
    found = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        found[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = found
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    found = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for s in order.tolist():
        code <<= int(lengths[s]) - last
        found[s], last = code, int(lengths[s])
        code += 1
    return found


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all values of as many next bits as the longest code has: the symbol, and its length."""
    longest = max(1, int(lengths.max(initial=0)))
    symbol, size = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    made = codes(lengths)
    for s in np.flatnonzero(lengths).tolist():
        n = int(lengths[s])
        a = int(made[s]) << (longest - n)
        symbol[a : a + (1 << (longest - n))], size[a : a + (1 << (longest - n))] = s, n
    return symbol, size


def packed(ids: np.ndarray, lengths: np.ndarray, made: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """The bits of some ids, the bit at which each block begins, and the number of bits."""
    wide, codes64 = lengths.astype(np.int64), made.astype(np.uint64)
    ends = np.cumsum(wide.take(ids))
    total = int(ends[-1]) if len(ids) else 0
    # a code lies in a window of 64 bits that begins with a word of 32; all codes of one window are put together
    windows, checkpoints = np.zeros((total + 31) // 32 + 1, np.uint64), []
    for i in range(0, len(ids), PACKED):
        part = ids[i : i + PACKED]
        size = wide.take(part)
        if not size.all():
            raise ValueError("an id has no code")
        begins = ends[i : i + PACKED] - size
        value = codes64.take(part) << (64 - size - (begins & 31)).view(np.uint64)
        word = begins >> 5
        first = np.flatnonzero(word[1:] != word[:-1]) + 1
        first = np.concatenate(([0], first))
        windows[word.take(first)] |= np.bitwise_or.reduceat(value, first)
        checkpoints.append(begins[::BLOCK])
    words = windows >> np.uint64(32)
    words[1:] |= windows[:-1] & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], np.concatenate(checkpoints) if checkpoints else np.zeros(0, np.int64), total


def window_bytes(longest: int) -> int:
    return (longest + 14) // 8


def unpacked(bits: bytes, checkpoints: np.ndarray, n: int, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The n ids: every block is decoded from its checkpoint on, all blocks side by side."""
    longest = len(symbol).bit_length() - 1
    wide = window_bytes(longest)
    raw = np.frombuffer(bits + bytes(wide), np.uint8).astype(np.uint64 if wide > 4 else np.uint32)
    window = sum(raw[k : len(raw) - wide + 1 + k] << raw.dtype.type(8 * (wide - 1 - k)) for k in range(wide))
    mask, left = raw.dtype.type(len(symbol) - 1), 8 * wide - longest
    at = checkpoints.astype(np.int64)
    out, steps = np.zeros((BLOCK, len(at)), np.uint32), size.astype(np.int64)
    for k in range(min(BLOCK, n)):
        live = len(at) - (k >= n - (len(at) - 1) * BLOCK)  # the last block may be shorter
        p = at[:live]
        seen = (window.take(p >> 3) >> (left - (p & 7)).astype(raw.dtype)) & mask
        symbol.take(seen, out=out[k, :live])
        p += steps.take(seen)
    return out.T.reshape(-1)[:n]


# ---- the encoder


#: What the tokenizer of lower-case words matches, and characters beyond those whose lower case is one plain character each.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Texts that the table of Latin pieces doesn't serve, as Arrow's expressions have it.
STRANGE = r"<\||[^\x00-\x{12f}\x{131}-\x{24f}]"
#: What the pattern takes together behind a word; an apostrophe may begin a match of its own.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Bytes that a generation of a table takes, about: of words that aren't letters alone, of pieces of Latin letters, of other pieces.
KEPT = 24 << 20, 128 << 20, 48 << 20
#: Bytes of texts that are encoded together.
TOGETHER = 4 << 20


class WordBpe:
    """The tokenizers library's encoder of one file that lower-cases, drops white space and marks word ends.

    White space is dropped, so a text is cut at spaces and line feeds. Pieces that a worker has met are
    taken from its table, else cut into words by the file's pattern; ids of new words come from the
    library's model. A word of letters is a piece too and kept as one, wherever it was met. Texts with
    other than Latin letters, or with what may be a special token, go through the whole tokenizer piece
    by piece. Of a column of texts each distinct piece is looked up once.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        #: Two bytes for an id where the vocabulary allows it.
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        with open(path, encoding="utf-8") as file:
            said = json.load(file)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in said["merges"]]
        # the words that this worker keeps take the place of the model's own table
        self.model = models.BPE(vocab=said["vocab"], merges=merges, cache_capacity=0, **{k: said[k] for k in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token") if said.get(k)})
        self.letters, self.split = dict(enumerate(byte_characters())), regex.compile(WORDS).findall
        self.known, self.latin, self.other = map(Kept, (self.word, self.piece, self.whole), KEPT)

    def word(self, word: str) -> bytes:
        # letters of ASCII stand for themselves
        said = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(said)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of a piece. A single word is kept as a piece only."""
        if piece.isalpha():
            return self.word(piece)
        head = piece.rstrip(MARKS)
        words = [head, piece[len(head) :]] if head.isalpha() else self.split(piece)
        return b"".join([(self.latin if w.isalpha() else self.known).one(w) for w in words])

    def whole(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of 16 or 32 bits."""
        for kept in (self.known, self.latin, self.other):
            kept.turn()
        return self._encode(text) if len(text) <= LONG else b"".join(map(self._encode, in_parts(text)))

    def encode_all(self, texts: pa.StringArray) -> pa.BinaryArray:
        """The ids of each text of a column, as `encode`. Long texts and strange ones are encoded one by one."""
        for kept in (self.known, self.latin, self.other):
            kept.turn()
        alone = pc.or_(pc.match_substring_regex(texts, STRANGE), pc.greater(pc.binary_length(texts), LONG))
        plain = pc.replace_substring(pc.utf8_lower(texts.filter(pc.invert(alone))), "\n", " ")
        # every text has a piece, be it the empty one
        pieces = pc.split_pattern(plain, " ")
        at = pieces.flatten().dictionary_encode()
        ids = pa.array(self.latin.each(at.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(at.indices)
        # the ids of a text's pieces lie one behind another, so only ends are taken anew
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(), dtype=np.int64)]).take(np.cumsum([0, *pc.list_value_length(pieces).to_numpy()]))
        joined = pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(ends.astype(np.int32)), ids.buffers()[2]])
        if len(plain) == len(texts):
            return joined
        rest = iter(joined.to_pylist())
        return pa.array([self.encode(t) if a else next(rest) for t, a in zip(texts.to_pylist(), alone.to_pylist(), strict=True)], pa.binary())

    def _encode(self, text: str) -> bytes:
        if "<|" in text or not text.isascii() and BEYOND.search(text):
            return self.other.joined(text.replace("\n", " ").split(" "))
        return self.latin.joined(text.lower().replace("\n", " ").split(" "))


_MADE: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One for each worker and file."""
    if path not in _MADE:
        _MADE[path] = WordBpe(path)
    return _MADE[path]


def encoded(docs: DataFrame, path: str, id_col: str, text_col: str, end: int = END) -> DataFrame:
    """doc_id, n and ids (binary, as `WordBpe.encode`) of every whole text, its end id among them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        last = array(bpe.code, [end]).tobytes()
        for batch in gathered(by_size(batches, "text"), "text", TOGETHER):
            ids = pc.binary_join_element_wise(bpe.encode_all(batch["text"]), pa.scalar(last, pa.binary()), pa.scalar(b"", pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pc.divide(pc.binary_length(ids), len(last)).cast(pa.int32()), ids], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text")).mapInArrow(work, "doc_id long, n int, ids binary")


def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `begin`, how many ids of its part stand before each row."""
    part, begin = None, 0
    for batch in batches:
        found = []
        for p, n in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), strict=True):
            part, begin = p, begin if p == part else 0
            found.append(begin)
            begin += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "begin"])


# ---- files


def write(docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode `docs` and write the data set `out`, in ascending order of ids; returns `out`.

    Null text counts as empty and has the end id only. Null ids come first; of equal ids the least
    sequence of ids comes first. An empty table gives a data set of no chunks. Other columns don't matter.
    The ids are written once, in the order of the files, and read twice: to count and to code. What
    reaches the driver is the count of each id and the size of each part.
    """
    spark = docs.sparkSession
    cuts = cuts_of(docs.select(F.col(id_col).cast("long").alias("d")).filter("d is not null"), "d", partitions(spark))
    rows = encoded(docs, tokenizer, id_col, text_col).withColumn("part", range_of(F.col("doc_id"), cuts).cast("int"))
    rows = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    rows = rows.mapInArrow(numbered, "doc_id long, n int, ids binary, part int, begin long")
    rows.write.option("compression", "zstd").parquet(plain := new_path(spark, "token-ids"))
    gone_at_exit(spark, plain)
    rows = spark.read.schema(rows.schema).parquet(plain)

    lengths = code_lengths(_counts(rows))
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{out}/codebook")
    held = spark.sparkContext.broadcast(lengths)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, chunk = codes(held.value), Chunk()
        for batch in batches:
            for row in batch.to_pylist():
                if not chunk.follows(row):  # the reader has gone to another part, or to another place in this one
                    yield from chunk.closed(held.value, made)
                chunk.add(row)
        yield from chunk.closed(held.value, made)

    rows.mapInArrow(code, CHUNKS).write.option("compression", "none").parquet(f"{out}/chunks")
    sizes = {r["part"]: r["n"] for r in spark.read.schema(CHUNKS).parquet(f"{out}/chunks").groupBy("part").agg(F.sum(F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    starts, start = [], 0
    for p in sorted(sizes):
        starts.append((p, start))
        start += sizes[p]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{out}/parts")
    return out


class Chunk:
    """Consecutive documents of one part, until they are coded."""

    def __init__(self) -> None:
        self.rows, self.size, self.next = [], 0, None

    def follows(self, row: dict) -> bool:
        return self.size < CHUNK and self.next == (row["part"], row["begin"])

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.size += row["n"]
        self.next = row["part"], row["begin"] + row["n"]

    def closed(self, lengths: np.ndarray, made: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.rows:
            flat = np.concatenate([_ids(r["ids"], r["n"]) for r in self.rows])
            bits, checkpoints, n_bits = packed(flat, lengths, made)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.rows[0]["part"]], pa.int32()), pa.array([self.rows[0]["begin"]], pa.int64()), pa.array([[r["doc_id"] for r in self.rows]], pa.list_(pa.int64())),
                 pa.array([[r["n"] for r in self.rows]], pa.list_(pa.int32())), pa.array([checkpoints], pa.list_(pa.int64())), pa.array([n_bits], pa.int64()), pa.array([bits], pa.binary())],
                names=["part", "begin", "doc_ids", "doc_sizes", "checkpoints", "n_bits", "bits"],
            )
        self.rows, self.size = [], 0


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


CHUNKS = "part int, begin long, doc_ids array<long>, doc_sizes array<int>, checkpoints array<long>, n_bits long, bits binary"


def _counts(rows: DataFrame) -> np.ndarray:
    """How often each id stands in the corpus: partial counts of a vocabulary's size from each task."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            ids = [_ids(raw, n) for raw, n in zip(batch["ids"].to_pylist(), batch["n"].to_pylist(), strict=True)]
            got = np.bincount(np.concatenate(ids) if ids else np.zeros(0, np.int64), minlength=len(held))
            got[: len(held)] += held
            held = got
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["id", "count"])

    counted = rows.select("n", "ids").mapInArrow(work, "id int, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    found = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    found[counted["id"].to_numpy()] = counted["count"].to_numpy()
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read a data set back: doc_id, start (ids of all documents before), n_tokens, ids binary (little-endian 32 bits)."""
    book = spark.read.schema("id int, length int").parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 0, np.uint8)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()
    held = spark.sparkContext.broadcast(lengths)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, size = decoding_table(held.value)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                raw = unpacked(row["bits"], np.array(row["checkpoints"]), int(ends[-1]), symbol, size).astype("<u4").tobytes()
                found = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * k, pa.int32()), pa.array(row["begin"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], schema=schema)

    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    made = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(work, "doc_id long, part int, begin long, n_tokens long, ids binary")
    # a row for each part of the files
    return made.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = write(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "tokens"))
    # crc32 of binary in Spark is the unsigned one of zlib
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

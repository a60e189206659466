"""BPE by a table of distinct words: Spark splits texts into words, each distinct word is encoded once, ids are joined back by position.

A text is a sequence of numbers in the word dictionary of its chunk (`lookup`). A dictionary is cut into parts by
the words' hashes, each sorted and packed; a part of all dictionaries meets in one task, where each distinct word is
encoded once with the tokenizers library's model. Ids go back to the dictionaries, and the word at each position of
a text gives its ids. The table of texts is dealt by chunk when it is written, so only packed words and ids are
shuffled. Decoding looks ids up in the table of ids and pieces, which is broadcast; a vocabulary that is too large
for it is joined with the ids of each chunk.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.bpe import Kept, byte_characters, lists
from nearvote.llm.common import bucketed, by_size, filled, let_go, partitions, stored, table
from nearvote.llm.lookup import by_chunk, chunk_numbers, packed, unpacked
from nearvote.llm.token_files import BEYOND, WORDS

#: Bytes of text, or of ids, in a chunk, about; a longer text is a chunk of its own.
CHUNK = 16 << 20
#: Pieces that a chunk keeps beside its words.
PIECES = 1 << 17
#: Parts of a dictionary: as many as shuffle partitions, and so many at most, that a part is worth packing.
PARTS = 512
#: Ids that a vocabulary may have to be broadcast: with its pieces a few MB.
MOST_IDS = 1 << 18


class Splitter:
    """The words of a text, as the tokenizer of one file makes them; its special tokens are words too.

    White space is dropped, so a text is cut at spaces and line feeds, and pieces that were met are taken
    from bounded tables. Texts with other than Latin letters, or with what may be a special token, are
    normalized and split by the library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = tuple(special)
        self.split = regex.compile(WORDS).findall
        self.latin, self.other = Kept(self.latin_words), Kept(self.other_words)

    def latin_words(self, piece: str) -> str:
        """Words of a lower-case piece, one to a line; no word holds white space."""
        return piece if piece.isalpha() else "\n".join(self.split(piece))

    def other_words(self, piece: str) -> str:
        parts = self.special.split(piece) if self.special else [piece]
        return "\n".join(w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.library_words(part)))

    def library_words(self, part: str) -> list[str]:
        said = self.tokenizer.normalizer.normalize_str(part)
        return [said[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(said)]

    def pieces(self, text: str) -> tuple[bool, list[str]]:
        """Whether a text is of Latin letters without special tokens, and its pieces."""
        plain = not any(m in text for m in self.marks) and (text.isascii() or not BEYOND.search(text))
        return plain, (text.lower() if plain else text).replace("\n", " ").split(" ")


class Dictionary(dict):
    """Words of a chunk by number, and the numbers of the pieces that it has met."""

    def __init__(self, splitter: Splitter) -> None:
        super().__init__()
        self.latin, self.other = (Numbers(self, kept) for kept in (splitter.latin, splitter.other))

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


class Numbers(dict):
    def __init__(self, words: Dictionary, kept: Kept) -> None:
        super().__init__()
        self.words, self.kept = words, kept

    def __missing__(self, piece: str) -> bytes:
        said = self.kept.one(piece)
        found = array("i", [self.words[w] for w in said.split("\n")] if said else []).tobytes()
        if len(self) < PIECES:
            self[piece] = found
        return found


_SPLITTERS: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """One for each worker and file."""
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def worded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each chunk a row for each document (chunk, doc_id, numbers), one for each part of its words (chunk, part, words), and one with the words' numbers in the order of the parts (chunk, part -1, numbers). Stored, dealt by chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("part", pa.int32()), ("words", pa.binary())])
    parts = min(PARTS, partitions(docs.sparkSession))

    def chunk(number: int, ids: list, numbers: list[bytes], words: Dictionary) -> Iterator[pa.RecordBatch]:
        import zstandard

        n, entries = len(ids), len(words)
        # frequent words get small numbers, whose higher bytes take no room
        often = np.argsort(-np.bincount(np.frombuffer(b"".join(numbers), np.int32), minlength=entries), kind="stable")
        place = np.empty(entries, np.int32)
        place[often] = np.arange(entries, dtype=np.int32)
        packs = [packed(place[np.frombuffer(x, np.int32)], entries) for x in numbers]
        yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array(packs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        of_part: dict[int, list[str]] = {}
        for word in words:
            of_part.setdefault(zlib.crc32(word.encode()) % parts, []).append(word)
        compress = zstandard.ZstdCompressor(level=9).compress
        said = [compress("\n".join(sorted(of_part[k])).encode()) for k in sorted(of_part)]
        order = packed(place[[words[w] for k in sorted(of_part) for w in sorted(of_part[k])]], entries)
        m = len(said) + 1
        yield pa.RecordBatch.from_arrays([pa.array([number] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([order] + [None] * (m - 1), pa.binary()), pa.array([-1, *sorted(of_part)], pa.int32()), pa.array([None, *said], pa.binary())], schema=schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, numbered = splitter(path), chunk_numbers()
        held, ids, numbers, words = 0, [], [], Dictionary(made)
        for batch in by_size(batches, "text"):
            made.latin.turn()
            made.other.turn()
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                plain, pieces = made.pieces(text)
                ids.append(i)
                numbers.append(b"".join(map((words.latin if plain else words.other).__getitem__, pieces)))
                held += len(text)
            if held >= CHUNK:
                yield from chunk(next(numbered), ids, numbers, words)
                held, ids, numbers, words = 0, [], [], Dictionary(made)
        if ids:
            yield from chunk(next(numbered), ids, numbers, words)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    return bucketed(rows.mapInArrow(work, "chunk long, doc_id long, numbers binary, part int, words binary"), "words", "chunk", partitions(docs.sparkSession))


_MODELS: dict[str, tuple] = {}


def model(path: str) -> tuple:
    """The library's model of one file, ids of special tokens, and the character of each byte."""
    if path not in _MODELS:
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            said = json.load(file)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in said["merges"]]
        bpe = models.BPE(vocab=said["vocab"], merges=merges, cache_capacity=0, **{k: said[k] for k in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token") if said.get(k)})
        _MODELS[path] = bpe, {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}, dict(enumerate(byte_characters()))
    return _MODELS[path]


ANY = 1 << 31


def numbered_ids(words: DataFrame, path: str) -> DataFrame:
    """chunk, part, sizes, ids (packed) of rows of chunk, part, words: how many ids each word has, and these one after another.

    A part of all chunks comes together in one partition, where each distinct word is encoded once. A chunk has a
    word once, so no word is hot; a task holds the distinct words of one part, and the entries of one row.
    """
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bpe, special, letters = model(path)

        class Ids(dict):
            def __missing__(self, word: str) -> bytes:
                found = [special[word]] if word in special else [t.id for t in bpe.tokenize(word.encode().decode("latin-1").translate(letters))]
                self[word] = raw = array("i", found).tobytes()
                return raw

        last, known = None, Ids()
        for batch in batches:
            sizes, ids = [], []
            for part, raw in zip(batch["part"].to_pylist(), batch["words"].to_pylist(), strict=True):
                if part != last:
                    last, known = part, Ids()
                found = [known[w] for w in zstandard.ZstdDecompressor().decompress(raw).decode().split("\n")]
                sizes.append(packed(np.array([len(x) >> 2 for x in found], np.int32), ANY))
                ids.append(packed(np.frombuffer(b"".join(found), np.int32), ANY))
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["part"], pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], schema=schema)

    return words.repartition("part").sortWithinPartitions("part").mapInArrow(work, "chunk long, part int, sizes binary, ids binary")


def ids_of_chunks(numbered: DataFrame) -> DataFrame:
    """chunk and id: the distinct ids of each chunk."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(unpacked(raw, ANY)) for raw in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["chunk"], lists(found)], names=["chunk", "ids"])

    return numbered.select("chunk", "ids").mapInArrow(work, "chunk long, ids array<int>").select("chunk", F.explode("ids").alias("id")).distinct()


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id and piece of a vocabulary, whose size is bounded by its file."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    rows = spark.createDataFrame(sorted((i, piece) for piece, i in vocabulary.items()), "id int, piece string")
    return F.broadcast(rows) if len(vocabulary) <= MOST_IDS else rows


class Pieces(dict):
    """Pieces by id, those of one chunk."""

    def __missing__(self, i: int) -> str:
        raise ValueError(f"no piece has the id {i}")


def known_pieces(spark: SparkSession, path: str) -> Broadcast[Pieces] | None:
    """All pieces of a vocabulary that is small enough to be broadcast.

    The ids of each chunk need no table then. Each task of words has some ids of each chunk, so before they
    are made distinct their rows grow with tasks times chunks.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return spark.sparkContext.broadcast(Pieces((i, piece) for piece, i in vocabulary.items())) if len(vocabulary) <= MOST_IDS else None


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: id, ids array<int>, decoded string. As `encoded` and `decoded` in turn.

    Null text counts as empty: no ids, and "" decoded. Null and repeated ids stay as they are, one row out
    for each row in; an empty table gives no rows; other columns don't matter. A chunk holds whole texts, so
    the memory of a task grows with the longest text.
    """
    chunks = worded(docs, path, id_col, text_col)
    rows = chunks.filter("part is null or part < 0").select("chunk", "doc_id", "numbers", "part")
    numbered = stored(numbered_ids(chunks.filter("part >= 0").select("chunk", "part", "words"), path), "numbered")
    let_go(docs.sparkSession)
    every = known_pieces(docs.sparkSession, path)
    found = numbered if every else numbered.unionByName(ids_of_chunks(numbered).join(piece_table(docs.sparkSession, path), "id").select("chunk", "id", "piece"), allowMissingColumns=True)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        heads = pc.is_valid(rows["part"])
        order, rows = rows.filter(heads), rows.filter(pc.invert(heads))
        of_words = found.filter(pc.is_valid(found["sizes"])).sort_by("part")
        sizes, flat = (np.concatenate([np.zeros(0, np.int32), *(unpacked(raw, ANY) for raw in of_words[c].to_pylist())]) for c in ("sizes", "ids"))
        entries, raw = len(sizes), flat.tobytes()
        ids_of: list[bytes] = [b""] * entries
        ends = (4 * np.cumsum(sizes, dtype=np.int64)).tolist()
        for n, begin, end in zip(unpacked(order["numbers"][0].as_py(), entries).tolist(), [0, *ends], ends):  # noqa: B905
            ids_of[n] = raw[begin:end]
        if every:
            piece_of = every.value
        else:
            of_pieces = found.filter(pc.is_valid(found["id"]))
            piece_of = Pieces(zip(of_pieces["id"].to_pylist(), of_pieces["piece"].to_pylist(), strict=True))
        ids = [np.frombuffer(b"".join(map(ids_of.__getitem__, unpacked(raw, entries).tolist())), np.int32) for raw in rows["numbers"].to_pylist()]
        said = [" ".join(map(piece_of.__getitem__, x.tolist())) for x in ids]
        return pa.Table.from_arrays([rows["doc_id"], lists(ids), pa.array(said, pa.string())], schema=schema)

    return by_chunk(rows, found, meet, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids array<int>, as in `round_trip`."""
    return round_trip(docs, path, id_col, text_col).drop("decoded")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded string of rows of ids: pieces by a join on the distinct ids of each chunk, with a space between. Null ids decode to ""; an unknown id raises."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("every", pa.list_(pa.int32()))])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in zip(chunk_numbers(), batches):  # noqa: B905
            n, one = batch.num_rows, pa.array([number], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), batch["doc_id"], batch["ids"], pa.nulls(n, pa.list_(pa.int32()))], schema=schema)
            yield pa.RecordBatch.from_arrays([one, pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([pc.unique(flattened_ids(batch["ids"])).to_pylist()], pa.list_(pa.int32()))], schema=schema)

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        piece_of = Pieces(zip(found["id"].to_pylist(), found["piece"].to_pylist(), strict=True)) if found.num_rows else Pieces()
        said = [" ".join(map(piece_of.__getitem__, ids or ())) for ids in rows["ids"].to_pylist()]
        return pa.Table.from_arrays([rows["doc_id"], pa.array(said, pa.string())], names=["id", "decoded"])

    kept = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    chunks = stored(kept.mapInArrow(work, "chunk long, doc_id long, ids array<int>, every array<int>"), "ids")
    found = chunks.filter("every is not null").select("chunk", F.explode("every").alias("id")).join(piece_table(tokens.sparkSession, path), "id").select("chunk", "id", "piece")
    return by_chunk(chunks.filter("every is null").select("chunk", "doc_id", "ids"), found, meet, "id long, decoded string").withColumnRenamed("id", id_col)


def flattened_ids(column: pa.Array) -> pa.Array:
    return pc.drop_null(pc.list_flatten(column))


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(table(spark, sf_dir, "documents"), vocabulary_file())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

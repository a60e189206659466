"""Byte-level BPE over Arrow batches with the tokenizers library, and decoding through the byte table.

A rank file maps byte strings to ids. The tokenizers library works on characters: each byte has a
character of its own, and a pair of neighbours merges by the rank of what they make. Texts are cut
where no match of the pattern can cross (before white space that follows other characters). Pieces
and words that a worker has met are taken from its bounded tables, and the ids of new words come
from the library's BPE model. So a long text is never held as one list of token objects.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.common import by_size, filled, table

#: White space as the patterns of the tokenizers have it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: No match of the pattern crosses the place between a character and white space after it.
PIECE = re.compile(SPACE + "*" + SPACE.replace("[", "[^", 1) + "+|" + SPACE + "+")
TWO_SPACES = re.compile(SPACE + SPACE)
#: Bytes that a generation of a table of pieces or words takes in a worker, about; the bytes of an entry beside
#: its key's and value's own. Longer keys aren't kept.
KEPT, ENTRY, KEPT_CHARS = 24 << 20, 200, 40


#: Characters of a long text that are encoded together, and where it may be cut: before white space after another character.
LONG = 1 << 19
CUT = re.compile("(?<=" + SPACE.replace("[", "[^", 1) + ")" + SPACE)


def in_parts(text: str) -> Iterator[str]:
    """A text in parts of about LONG characters whose ids are, one after another, those of the text."""
    at = 0
    while len(text) - at > LONG and (cut := CUT.search(text, at + LONG)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def spaced(text: str) -> bool:
    """Two white-space characters meet in a text. Of most texts four searches for a string tell, which are faster than the expression."""
    if text.isascii() and not any(c in text for c in "\t\v\f\r"):
        return any(two in text for two in ("  ", "\n\n", " \n", "\n "))
    return TWO_SPACES.search(text) is not None


class Kept:
    """What `make` gives for a key, kept in two generations: what was used since the last turn survives the next one.

    Both generations together take twice `most` bytes, and what one call of `joined` adds.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT) -> None:
        self.most, self.new = most, Generation(make, {})

    def one(self, key: str) -> bytes:
        return self.new[key]

    def joined(self, keys: list[str]) -> bytes:
        return b"".join(map(self.new.__getitem__, keys))

    def each(self, keys: list[str]) -> list[bytes]:
        return list(map(self.new.__getitem__, keys))

    def turn(self) -> None:
        if self.new.held > self.most:
            self.new.old = {}
            self.new = Generation(self.new.make, self.new)


class Generation(dict):
    """A table that looks for what it lacks in the one before it, or makes it."""

    def __init__(self, make: Callable[[str], bytes], old: dict) -> None:
        super().__init__()
        self.make, self.old, self.held = make, old, 0

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= KEPT_CHARS:
            self[key] = found
            self.held += len(key) + len(found) + ENTRY
        return found


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    held = set(own)
    return [chr(b) if b in held else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of tokens that make a token, by the rank of what they make; of one token's pairs, long left parts first."""
    found = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        found += [(token[:i], token[i:]) for i in range(len(token) - 1, 0, -1) if token[:i] in ranks and token[i:] in ranks]
    return found


def ambiguous_overlaps(ranks: dict[bytes, int]):
    """An automaton over byte strings u+v+w where u+v and v+w are the same token made of different pairs.

    Of these the leftmost must merge first; a list of merges gives one pair precedence wherever it
    stands. A word that holds such a string is merged by the ranks themselves (`by_ranks`).
    """
    import ahocorasick

    found = set()
    for token in ranks:
        for i in range(1, len(token)):
            # v is a border of the token; u is what precedes it, w what follows it
            u, v = token[:i], token[i:]
            if u != v and u in ranks and v in ranks and token.startswith(v) and (w := token[len(v) :]) in ranks and (u, v) != (v, w):
                found.add(u + v + w)
    strings = ahocorasick.Automaton()
    for x in found:
        strings.add_word(x.decode("latin-1"), True)
    strings.make_automaton()
    return strings if found else None


def by_ranks(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of least rank, leftmost first, until none make a token. n log n in the word's length."""
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, size = heapq.heappop(queue)
        if (a := part[i]) is None or (j := right[i]) == n or len(a) + len(part[j]) != size:
            continue  # one of the two has merged since
        part[i], part[j], right[i] = a + part[j], None, right[j]
        if right[j] < n:
            left[right[j]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < n and (r := ranks.get(both := part[k] + part[right[k]])) is not None:
                heapq.heappush(queue, (r, k, len(both)))
    return [ranks[p] for p in part if p is not None]


class ByteBpe:
    """An encoder and decoder for one rank file. Ids are kept as little-endian bytes of `width` each."""

    def __init__(self, path: str, pattern: str, width: int = 2) -> None:
        import regex
        from tokenizers import models

        self.ranks, self.split = read_ranks(path), regex.compile(pattern).findall
        self.dtype = np.dtype("<u2" if max(self.ranks.values(), default=0) < 1 << 16 and width == 2 else "<u4")
        self.letters = dict(enumerate(byte_characters()))
        said = lambda b: b.decode("latin-1").translate(self.letters)
        self.model = models.BPE(vocab={said(k): v for k, v in self.ranks.items()}, merges=[(said(a), said(b)) for a, b in merges_of(self.ranks)], cache_capacity=0)
        self.overlaps = ambiguous_overlaps(self.ranks)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.pieces, self.known = Kept(self.keyed), Kept(self.word)
        self.table: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.table[i] = token
        self.lengths = np.array([len(t or b"") for t in self.table], np.int64)

    def words(self, piece: str) -> list[str]:
        """The matches of the pattern in a piece."""
        return [piece] if piece[piece[:1] == " " :].isalpha() else self.split(piece)

    def word(self, word: str) -> bytes:
        raw = word.encode()
        if self.overlaps is not None and next(self.overlaps.iter(raw.decode("latin-1")), None):
            return array(self.code, by_ranks(raw, self.ranks)).tobytes()
        return array(self.code, [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, word by word."""
        return b"".join(map(self.known.one, self.words(piece)))

    def keyed(self, key: str) -> bytes:
        """The ids of the piece that a key stands for. A single word is kept under its key only."""
        words = self.words(key if key[:1] == "\n" else " " + key)
        return self.word(words[0]) if len(words) == 1 else b"".join(map(self.known.one, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes.

        Where no two white-space characters meet, a text is cut before every space and line feed. The
        key of a piece in the table is what follows its space, or all of it after a line feed.
        """
        self.pieces.turn()
        self.known.turn()
        return [self._encode(t) if len(t) <= LONG else b"".join(map(self._encode, in_parts(t))) for t in texts]

    def _encode(self, text: str) -> bytes:
        if spaced(text):
            return b"".join(map(self.piece, PIECE.findall(text)))
        first, *keys = text.replace("\n", " \n").split(" ")
        rest = self.pieces.joined(keys)
        return self.piece(first) + rest if first else rest

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.dtype)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids. Characters split between tokens come together again here."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Start and end of each token in code points; a token that holds part of a character spans all of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        leads = (raw & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(leads)))  # code points that begin before each byte
        ends = np.cumsum(self.lengths[ids]) if len(ids) else np.zeros(0, np.int64)
        starts = ends - self.lengths[ids] if len(ids) else ends
        first = before[starts] - ~np.append(leads, True)[starts]  # inside a character: the one that it belongs to
        return np.stack([first, before[ends]], axis=1).astype(np.int32)


_MADE: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """One for each worker, rank file and pattern."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(path, pattern)
    return _MADE[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Encode every whole text: id, ids array<int>, and with `offsets` starts and ends array<int>.

    Null text counts as empty and has no ids. Null and repeated ids stay as they are: one row out for
    each row in. An empty table gives no rows; other columns don't matter. `offsets` are code points.
    """
    kinds = [pa.field("id", pa.int64()), pa.field("ids", pa.list_(pa.int32()))] + [pa.field(n, pa.list_(pa.int32())) for n in ("starts", "ends")] * offsets
    schema = pa.schema(kinds)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in by_size(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids = [bpe.ids(raw) for raw in bpe.encode(texts)]
            columns = [batch.column("id"), lists(ids)]
            if offsets:
                at = [bpe.offsets(i, t) for i, t in zip(ids, texts, strict=True)]
                columns += [lists([x[:, k] for x in at]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets).withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """Decode every row's ids: id, decoded binary and the columns in `carry`. Null ids decode to nothing; an unknown id raises."""
    kept = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"), *carry)
    made = f"{kept.select('id', *carry)._jdf.schema().toDDL()}, decoded binary"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            flat, ends = flattened(batch.column("ids"))
            found = [bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            at = {n: batch.column(n) for n in batch.schema.names if n != "ids"}
            yield pa.RecordBatch.from_arrays([*at.values(), pa.array(found, pa.binary())], names=[*at, "decoded"])

    return kept.mapInArrow(work, made).withColumnRenamed("id", id_col)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and where each row begins and ends."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids in the same task: id, ids array<int>, decoded binary. As `encoded` and `decoded` in turn."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in by_size(batches, "text"):
            ids = [bpe.ids(raw) for raw in bpe.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(ids), pa.array([bpe.decode(i) for i in ids], pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(rows: DataFrame, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Of the rows of `round_trip`: id, number of ids, hashes of the decimal ids and of the decoded bytes, and the columns in `carry`."""
    return rows.select(
        id_col, *carry, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents"), *public_ranks()))

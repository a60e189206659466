"""Two tokenizers side by side: which tokens of one overlap which of the other, and how often over the whole corpus.

A is byte-level BPE, B a piece model with byte fallback; a text with a space before it is their common byte
string. Inside mapInPandas the ends of A's and B's tokens, both ascending, are merged: an end of both closes
a group, and between two neighbouring ends of either lies one overlap of an A and a B token, a link. All
texts of a batch stand in one byte string, so one merge aligns all of them.

Links are kept as numbers in a dictionary of id pairs for each chunk (`lookup`). Spark counts the documents
of each pair, takes the highest count of each A id and each B id, and joins these back to the dictionaries.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.bpe import LONG, ByteBpe, Kept, byte_characters
from nearvote.llm.common import filled, stored, table
from nearvote.llm.lookup import by_chunk, chunk_numbers, packed, unpacked
from nearvote.llm.token_files import BEYOND

#: Bytes of text in a chunk, and in a batch that is aligned at once, about; a longer text is one by itself.
CHUNK, BATCH = 8 << 20, 1 << 20
#: Bytes that a generation of a worker's table takes here, about: there are three tables of two, one made out of another.
KEPT = 56 << 20
#: Ids of one side whose maxima are broadcast: under 4 MB.
MOST_IDS = 1 << 18


class FileByteBpe(ByteBpe):
    """A byte-level encoder from a tokenizers file, special tokens as plain text; ids are bytes of two or four each."""

    def __init__(self, path: str) -> None:
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            said = json.load(file)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in said["merges"]]
        self.model = models.BPE(vocab=said["vocab"], merges=merges, cache_capacity=0)
        self.split, self.library, self.overlaps = regex.compile(PATTERN).findall, Tokenizer.from_file(path).pre_tokenizer, None
        self.letters = dict(enumerate(byte_characters()))
        of = {c: b for b, c in self.letters.items()}
        self.table = [b""] * (max(said["vocab"].values()) + 1)
        for token, i in said["vocab"].items():
            self.table[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.dtype = np.dtype("<u2" if len(self.table) <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.pieces, self.known = Kept(self.keyed, KEPT), Kept(self.word, KEPT)

    def words(self, piece: str) -> list[str]:
        if not piece.isascii() and BEYOND.search(piece):
            return [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]
        return super().words(piece)


#: A piece of a text with a space before it: spaces and what follows them, or a line feed and what follows it.
SEGMENT = re.compile(" +[^ \n]*|\n[^ \n]*")
#: Where a long text may be cut.
CUT = re.compile("(?<=[^ ]) ")


class PieceBpe:
    """A sentencepiece encoder that keeps the ids of segments.

    Where no piece of the model goes on after a space that follows another character, or holds a line feed,
    a text's ids are those of its segments one after another. Each segment is compared with the bytes of its
    ids; a text with one that differs is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        said = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in said]
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.dtype, self.wrong = np.dtype("<u4"), len(said)
        self.space = self.model.piece_to_id("▁")
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in said) and said[self.space] == "▁"
        self.segments = Kept(self.segment, KEPT)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def segment(self, key: str) -> bytes:
        """The ids of a line feed and what follows it, or of a space and the key."""
        if key[:1] == "\n":
            ids, said = self.model.encode(key)[1:], key  # the model puts a space before every text
        else:
            ids, said = self.model.encode(key) if key else [self.space], f" {key}"
        return array("I", ids if self.bytes_of(ids) == said.encode() else (self.wrong,)).tobytes()

    def keys(self, said: str) -> list[str]:
        if "  " in said or " \n" in said:
            return [x[x[0] == " " :] for x in SEGMENT.findall(said)]
        return said.replace("\n", " \n").split(" ")[1:]

    def encode(self, text: str) -> bytes | None:
        """The ids of a text that isn't empty, four bytes each; None if their bytes aren't those of a space and the text."""
        self.segments.turn()
        said, at, parts = f" {text}", 0, []
        while self.apart and len(said) - at > LONG and (cut := CUT.search(said, at + LONG)):
            parts.append(self.segments.joined(self.keys(said[at : cut.start()])))
            at = cut.start()
        if self.apart:
            found = b"".join([*parts, self.segments.joined(self.keys(said[at:]))])
            if self.wrong not in np.frombuffer(found, self.dtype):
                return found
        ids = self.model.encode(text)
        return np.array(ids, self.dtype).tobytes() if self.bytes_of(ids) == said.encode() else None


_PAIRS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One for each worker and pair of files."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Aligner(a, b)
    return _PAIRS[a, b]


class Aligner:
    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = FileByteBpe(a), PieceBpe(b)
        self.size_a, self.size_b = len(self.a.table), len(self.b.table)
        self.pairs = self.size_a * self.size_b
        # ids as text, each with what follows it: inside a side of a group, and at the side's end
        self.texts = [f"{i}{x}" for n, end in ((self.size_a, "|"), (self.size_b, ";")) for i in range(n) for x in (",", end)]

    def encoded(self, text: str) -> tuple[bytes, bytes]:
        """Ids of either side; none where the bytes don't agree."""
        ids = self.b.encode(text) if text else None
        if ids is None:
            return b"", b""
        first = self.a.encode([f" {text}"])[0]
        return (first, ids) if int(self.a.lengths[self.a.ids(first)].sum()) == len(text.encode()) + 1 else (b"", b"")

    def align(self, texts: list[str]) -> Aligned:
        """One merge of the ends of all tokens of some texts."""
        both = [self.encoded(t) for t in texts]
        a, b = np.frombuffer(b"".join(x for x, _ in both), self.a.dtype).astype(np.int64), np.frombuffer(b"".join(x for _, x in both), self.b.dtype).astype(np.int64)
        n_a, n_b = np.array([len(x) // self.a.dtype.itemsize for x, _ in both], np.int64), np.array([len(x) // self.b.dtype.itemsize for _, x in both], np.int64)
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        closes = np.concatenate(([0], ends_a))[np.cumsum(n_a)]  # where each text ends
        # the merge: two ascending runs; of an end of both, A's comes first
        ends = np.concatenate([ends_a, ends_b])
        order = np.argsort(ends, kind="stable")
        ends, of_a = ends[order], order < len(a)
        last = np.append(ends[1:] != ends[:-1], True) if len(ends) else np.zeros(0, bool)
        shared = np.zeros(len(ends), bool)
        shared[1:] = ~last[:-1]
        seen_a = np.cumsum(of_a)
        at = np.flatnonzero(last)
        first, both_end = seen_a[at], shared[at]
        second = at + 1 - first
        first, second = first - (of_a[at] | both_end), second - ~of_a[at]
        text = np.searchsorted(closes, ends[at], "left")
        links = np.bincount(text, minlength=len(texts))
        groups = np.bincount(text[both_end], minlength=len(texts))
        keys, times = np.unique(text * self.pairs + a[first] * self.size_b + b[second], return_counts=True)
        return Aligned(n_a, n_b, groups, links, self.written(a, b, n_a + n_b, ends_a, ends_b, ends[at][both_end]), keys, times)

    def written(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray) -> list[str]:
        """The groups of each text: ids of A and B, groups apart by semicolons."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        number = np.arange(len(common))
        codes = np.zeros(len(a) + len(b), np.int64)
        # before a token of A stand those of B of earlier groups, before one of B those of A of its own group too
        codes[np.arange(len(a)) + np.searchsorted(group_b, number)[group_a]] = 2 * a + (ends_a == common[group_a])
        codes[np.arange(len(b)) + np.searchsorted(group_a, number, "right")[group_b]] = 2 * (self.size_a + b) + (ends_b == common[group_b])
        said, out, begun = list(map(self.texts.__getitem__, codes.tolist())), [], 0
        for n in sizes.tolist():
            out.append("".join(said[begun : begun + n])[:-1])
            begun += n
        return out


class Aligned:
    """Of some texts: counts, groups as text, and the id pairs of links, numbered by text, with how often each comes."""

    def __init__(self, n_a, n_b, n_groups, n_links, groups, keys, times) -> None:
        self.counts, self.groups, self.keys, self.times = (n_a, n_b, n_groups, n_links), groups, keys, times


CHUNKS = "chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, most int, keys array<long>, held array<int>"


def chunked(docs: DataFrame, a: str, b: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """Of each chunk a row for each document, and one with the id pairs and how many documents hold each. Stored."""

    def rows_of(number: int, ids: list, parts: list[Aligned]) -> Iterator[pd.DataFrame]:
        size = aligner(a, b).pairs
        begun = np.cumsum([0, *(len(p.groups) for p in parts)])
        text = np.concatenate([p.keys // size + n for p, n in zip(parts, begun[:-1], strict=True)])
        keys, at, held = np.unique(np.concatenate([p.keys % size for p in parts]), return_inverse=True, return_counts=True)
        times = np.concatenate([p.times for p in parts])
        cuts = np.searchsorted(text, np.arange(len(ids) + 1))
        most = int(times.max(initial=0))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        n_a, n_b, n_groups, n_links = (np.concatenate([p.counts[k] for p in parts]) for k in range(4))
        groups = [hashlib.sha256(g.encode()).hexdigest() if digest and g else g for p in parts for g in p.groups]
        yield pd.DataFrame({
            "chunk": number, "doc_id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups,
            "pairs": [packed(at[i:j], len(keys)) for i, j in spans], "times": [packed(times[i:j], most + 1) for i, j in spans], "most": most, "keys": None, "held": None,
        })
        empty = dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "most"))
        yield pd.DataFrame([{"chunk": number, **empty, "keys": keys, "held": held.astype(np.int32)}])

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, numbers = aligner(a, b), chunk_numbers()
        ids, parts, held = [], [], 0
        for frame in frames:
            some, size = [], 0
            texts = frame["text"].tolist()
            for k, text in enumerate(texts):
                some.append(text)
                size += len(text)
                if size >= BATCH or k + 1 == len(texts):
                    parts.append(made.align(some))
                    held, some, size = held + size, [], 0
            ids += frame["id"].tolist()
            if held >= CHUNK:
                yield from rows_of(next(numbers), ids, parts)
                ids, parts, held = [], [], 0
        if ids:
            yield from rows_of(next(numbers), ids, parts)

    # ids as text: pandas would make a column of longs with nulls a column of doubles
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), filled(text_col).alias("text"))
    return stored(rows.mapInPandas(work, CHUNKS), "alignment")


def pair_table(chunks: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """key, a, b, count (documents that hold the pair), best_a and best_b (no pair of its A, or B, id has more). Stored."""
    each = chunks.filter("keys is not null").select(F.explode(F.arrays_zip("keys", "held")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.held").alias("held"))
    counts = each.groupBy("key").agg(F.sum("held").alias("count"))
    counts = stored(counts.select("key", F.expr(f"key div {size_b}").alias("a"), (F.col("key") % size_b).alias("b"), "count"), "pair-counts")
    found = counts
    for side, size in (("a", size_a), ("b", size_b)):
        top = counts.groupBy(side).agg(F.max("count").alias(f"most_{side}"))  # a row for each id of a vocabulary
        found = found.join(F.broadcast(top) if size <= MOST_IDS else top, side)
    return found.select("key", "a", "b", "count", *[(F.col("count") == F.col(f"most_{s}")).alias(f"best_{s}") for s in "ab"])


def looked_up(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunk, number, and what `pairs` has of each entry."""
    return chunks.filter("keys is not null").select("chunk", F.posexplode("keys").alias("number", "key")).join(pairs, "key")


def _sorted(found: pa.Table, *names: str) -> list[np.ndarray]:
    order = np.argsort(found["number"].to_numpy()) if found.num_rows else np.zeros(0, np.int64)
    return [found[n].to_numpy()[order] if found.num_rows else np.zeros(0, np.int64) for n in names]


def sizes(a: str, b: str) -> tuple[int, int]:
    """How many ids either file has."""
    import sentencepiece

    with open(a, encoding="utf-8") as file:
        size = max(json.load(file)["model"]["vocab"].values()) + 1
    return size, sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups, n_best, n_best_b, count_sum of every document.

    groups: `a1,a2|b1;a3|b2,b3`, or with `digest` its SHA-256 (of no groups: ""). A link's count is in how many
    documents its two ids are linked; n_best are the links whose count is the highest of their A id, n_best_b
    of their B id, ties included; count_sum adds the counts of all links. A text that is null, empty or not
    what its ids say has no tokens and zeros. Null and repeated ids stay as they are, one row out for each row
    in, and each row counts as a document. An empty table gives no rows; other columns don't matter. A chunk
    holds whole texts, so the memory of a task grows with the longest text.
    """
    chunks = chunked(docs, a, b, id_col, text_col, digest)
    found = looked_up(chunks, pair_table(chunks, *sizes(a, b))).select("chunk", "number", "count", F.col("best_a").cast("int").alias("best_a"), F.col("best_b").cast("int").alias("best_b"))

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        columns, sums = _sorted(found, "count", "best_a", "best_b"), []
        for pairs, times, most in zip(rows["pairs"].to_pylist(), rows["times"].to_pylist(), rows["most"].to_pylist(), strict=True):
            at, n = unpacked(pairs, len(columns[0])), unpacked(times, most + 1).astype(np.int64)
            sums.append([int((c[at] * n).sum()) for c in columns])
        kept = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
        for k, name in enumerate(("count_sum", "n_best", "n_best_b")):
            kept = kept.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
        return kept

    rows = chunks.filter("keys is null").drop("keys", "held")
    made = by_chunk(rows, found, meet, "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, count_sum long, n_best long, n_best_b long")
    return made.select(F.col("doc_id").cast("long").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "n_best_b", "count_sum")


def links(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a, b, times, count, best_a, best_b: the linked id pairs of every document, how often each comes in it, and what the corpus says of it. Rows as in `aligned`."""
    chunks = chunked(docs, a, b, id_col, text_col, True)
    found = looked_up(chunks, pair_table(chunks, *sizes(a, b))).drop("key")

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        names, out = ["a", "b", "count", "best_a", "best_b"], []
        order = pa.array(np.argsort(found["number"].to_numpy()) if found.num_rows else [], pa.int64())
        kept = found.select(names).take(order) if found.num_rows else None
        for i, pairs, times, most in zip(rows["doc_id"].to_pylist(), rows["pairs"].to_pylist(), rows["times"].to_pylist(), rows["most"].to_pylist(), strict=True):
            if kept is not None and len(at := unpacked(pairs, kept.num_rows)):
                part = kept.take(pa.array(at.astype(np.int64)))
                one = part.append_column("times", pa.array(unpacked(times, most + 1).astype(np.int64)))
                out.append(one.append_column("doc_id", pa.array([i] * len(at), pa.string())).select(["doc_id", "a", "b", "times", "count", "best_a", "best_b"]))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.string()), *((n, pa.int64()) for n in ("a", "b", "times", "count")), ("best_a", pa.bool_()), ("best_b", pa.bool_())]).empty_table()

    rows = chunks.filter("keys is null").select("chunk", "doc_id", "pairs", "times", "most")
    made = by_chunk(rows, found, meet, "doc_id string, a long, b long, times long, count long, best_a boolean, best_b boolean")
    return made.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("doc_id", id_col)


def public_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), *public_files(), digest=True).withColumnRenamed("groups", "groups_sha256")

"""Document fingerprints that add up: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph (a line) hashes to a vector of 273 lanes of 32 bits: 16 from the paragraph as it stands, one
that counts its units, and 256 that are sums over its units. A fingerprint is the sum of the vectors of
all paragraphs, each lane modulo 2**32. So it doesn't depend on their order, and paragraphs can be added
and taken away without the rest of the text. Equal texts have equal fingerprints.

Units are what likeness is taken from: every token with the four before it in its line, whatever
separates them, and every clause, which counts as much as four tokens. Each lane sums Cauchy numbers
drawn by hash, so the median of the lanes' differences estimates how many units two texts don't share,
each as often as it is repeated.

Tokens and clauses are found in the code points of many texts at once, by classes of characters. Of a
text and the edited one only what differs is looked at, and what it has from the next text is summed
where that one is: each unit's numbers are added once, between places where a sum must begin or end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.common import by_size, cuts_of, filled, partitions, range_of, table

EXACT, LIKE = 16, 256
CLAUSE = re.compile(r"[^\s.,;:!?|](?:[^.,;:!?|\n]*[^\s.,;:!?|])?")
#: Scripts that don't part words by spaces: Thai, Lao, Tibetan, Burmese, Khmer, Chinese, Japanese.
_UNSPACED = r"\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Words of up to 24 characters, else single characters.
TOKEN = re.compile(rf"(?<![^\W{_UNSPACED}])[^\W{_UNSPACED}]{{1,24}}(?![^\W{_UNSPACED}])|\S")
#: The same where all characters are ASCII.
TOKEN_ASCII = re.compile(r"(?<!\w)\w{1,24}(?!\w)|[^\s\x1c-\x1f]", re.ASCII)
#: Tokens before one that belong to its unit; how much a clause counts; the scale of the Cauchy numbers; units summed at once.
BEFORE, CLAUSE_WEIGHT, SCALE, AT_ONCE = 4, 4, 8, 256
#: Characters of a word that is one token; characters of texts that are taken apart together, about.
LONGEST_WORD, TOGETHER = 24, 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BITS = _mixed(np.arange(1, 2 * (65536 + LIKE) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16)
#: Two streams of Cauchy numbers of half the scale; a window of either is what one half of a hash stands for in all lanes.
_FIRST, _SECOND = (
    np.lib.stride_tricks.sliding_window_view(half, LIKE)
    for half in np.rint(SCALE / 2 * np.tan(np.pi * ((np.arange(65536) + 0.5) / 65536 - 0.5))).astype(np.int32).view(np.uint32)[_BITS].reshape(2, -1)
)


#: What ends a clause, besides the end of its line.
_DELIMITER = np.zeros(0x110000, bool)
_DELIMITER[[ord(c) for c in ".,;:!?|"]] = True
#: What a byte adds to a CRC-32: that of one byte without the turning of bits at both ends.
_STEP = np.array([zlib.crc32(bytes([b ^ 0xFF])) for b in range(256)], np.uint32) ^ np.uint32(0xFF000000)


def tokens_of(paragraph: str) -> list[str]:
    """The tokens as expressions have them; `found_in` has the same."""
    return (TOKEN_ASCII if paragraph.isascii() else TOKEN).findall(paragraph)


@cache
def _classes() -> np.ndarray:
    """Of each code point: 0 for white space, 1 for characters of words, 2 for others."""
    every = "".join(map(chr, range(0x110000)))
    found = np.full(len(every), 2, np.uint8)
    for k, of in enumerate((r"\s+", rf"[^\W{_UNSPACED}]+")):
        for m in re.finditer(of, every):
            found[m.start() : m.end()] = k
    return found


def _crc32(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """zlib.crc32 of stretches of some bytes, each of one byte at least."""
    if not len(begins):
        return np.zeros(0, np.uint32)
    order = np.argsort(-sizes.astype(np.int16), kind="stable").astype(np.int32 if len(sizes) < 1 << 31 else np.int64)  # the longest ones first, so that those with a k-th byte stand together
    at, state = begins[order], np.full(len(begins), 0xFFFFFFFF, np.uint32)
    with_byte = len(begins) - np.cumsum(np.bincount(sizes))
    for k, n in enumerate([len(begins), *with_byte[1:-1].tolist()]):
        now = state[:n]
        state[:n] = _STEP[(now & np.uint32(0xFF)) ^ raw[at[:n] + k]] ^ (now >> np.uint32(8))
    found = np.empty_like(state)
    found[order] = ~state
    return found


class Digests(dict):
    """The hash of each clause, made once."""

    def __missing__(self, clause: bytes) -> bytes:
        self[clause] = found = hashlib.blake2b(clause, digest_size=8, person=b"clause").digest()
        return found


@dataclass(frozen=True)
class Found:
    """The units of some texts, one text behind another: their hashes, the code point of its text at which each ends, and where each text's begin, and the last one's end."""

    units: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def of(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.bounds[text], self.bounds[text + 1])
        return self.units[here], self.ends[here]

    @staticmethod
    def joined(parts: list[Found]) -> Found:
        sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(x.bounds) for x in parts]])
        return Found(np.concatenate([x.units for x in parts]), np.concatenate([x.ends for x in parts]), np.cumsum(sizes))


def found_in(texts: list[str], digests: Digests | None = None) -> tuple[Found, Found]:
    """The units of the tokens of texts, and those of their clauses. Lines of a text don't share units."""
    digests, parts, begun, size = Digests() if digests is None else digests, [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= TOGETHER or i == len(texts) - 1:
            parts.append(_found_in(texts[begun : i + 1], digests))
            begun, size = i + 1, 0
    if not parts:
        return (Found(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)),) * 2
    return tuple(Found.joined(list(p)) for p in zip(*parts, strict=True))


def _found_in(texts: list[str], digests: Digests) -> tuple[Found, Found]:
    joined = "\n".join(texts)
    points, raw = np.frombuffer(joined.encode("utf-32-le"), "<u4"), joined.encode()
    classes = _classes().take(points)
    # words of up to 24 characters are tokens, characters of longer ones and others but white space are each one
    word = np.zeros(len(points) + 2, np.int8)
    word[1:-1] = classes == 1
    turns = np.flatnonzero(word[1:] != word[:-1])
    first, size = turns[::2], turns[1::2] - turns[::2]
    sizes = np.zeros(len(points), np.uint8)
    sizes[classes == 2] = 1
    short = size <= LONGEST_WORD
    sizes[first[short]] = size[short]
    for a, n in zip(first[~short].tolist(), size[~short].tolist(), strict=True):
        sizes[a : a + n] = 1
    begins = np.flatnonzero(sizes)
    ends = begins + sizes.take(begins)
    del classes, word, sizes, turns, first, size, short
    at, to = begins, ends  # in bytes
    if len(raw) > len(points):
        widths = np.ones(len(points), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            widths += points >= least
        places = np.zeros(len(points) + 1, np.int32 if len(raw) < 1 << 31 else np.int64)
        np.cumsum(widths, out=places[1:])
        at, to = places.take(begins), places.take(ends)
        del widths, places
    h = _mixed(_crc32(np.frombuffer(raw, np.uint8), at, to - at).astype(np.uint64) + np.uint64(1))
    lines = np.diff(np.searchsorted(begins, np.concatenate([[0], np.flatnonzero(points == 10) + 1, [len(points)]])))
    place = np.arange(len(h)) - np.repeat(np.cumsum(lines) - lines, lines)  # of a token in its line
    units = h.copy()
    for k in range(1, min(BEFORE, len(h) - 1) + 1):
        units[k:] += h[:-k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) * (place[k:] >= k)
    del h
    # a clause is a run of tokens in a line without a delimiter, which is always a token of its own
    inside = ~_DELIMITER.take(points.take(begins))
    new = inside & (place == 0)
    new[1:] |= inside[1:] & ~inside[:-1]
    done = inside.copy()
    done[:-1] &= ~inside[1:] | (place[1:] == 0)
    new, done = np.flatnonzero(new), np.flatnonzero(done)
    clauses = np.frombuffer(b"".join([digests[raw[a:b]] for a, b in zip(at.take(new).tolist(), to.take(done).tolist(), strict=True)]), "<u8")
    begun = np.cumsum([0, *[len(t) + 1 for t in texts]])  # of each text

    def found(units: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Found:
        bounds = np.searchsorted(begins, begun)
        return Found(units, ends - np.repeat(begun[:-1], np.diff(bounds)), bounds)

    return found(_mixed(units), begins, ends), found(clauses, begins.take(new), ends.take(done))


def token_units(paragraphs: list[str]) -> np.ndarray:
    """A 64-bit hash for each token of some paragraphs and the tokens before it in its own, BEFORE at most."""
    return found_in(paragraphs)[0].units


def clause_units(paragraphs: list[str]) -> np.ndarray:
    """A 64-bit hash for each clause of some paragraphs."""
    return found_in(paragraphs)[1].units


@dataclass(frozen=True)
class Units:
    """Paragraphs with the units of all of them, and how many each has."""

    paragraphs: list[str]
    tokens: tuple[np.ndarray, np.ndarray]
    clauses: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(paragraphs: list[str]) -> Units:
        return Units(paragraphs, *((x.units, np.diff(x.bounds)) for x in found_in(paragraphs)))

    def after(self, paragraphs: int) -> tuple[np.ndarray, np.ndarray]:
        """The units behind the first so many paragraphs."""
        return tuple(units[sizes[:paragraphs].sum() :] for units, sizes in (self.tokens, self.clauses))

    def vectors(self) -> np.ndarray:
        """The sum of the vectors of the paragraphs; uint32 lanes, modulo 2**32."""
        return np.concatenate([whole_lanes(self.paragraphs), likeness_lanes(self.tokens[0], self.clauses[0])])


def lanes_of(units: np.ndarray) -> np.ndarray:
    """The sums over units of the Cauchy numbers that each one's hash stands for; uint32, modulo 2**32.

    A number is the sum of one from either stream: Cauchy again, of the whole scale.
    """
    like = np.zeros(LIKE, np.uint32)
    halves = (units & np.uint64(0xFFFF)).astype(np.intp), ((units >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)
    for of, at in zip((_FIRST, _SECOND), halves, strict=True):
        for k in range(0, len(units), AT_ONCE):
            like += np.add.reduce(of[at[k : k + AT_ONCE]], axis=0, dtype=np.uint32)
    return like


def lanes_between(units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """`lanes_of` the units between each bound and the next; bounds ascend from 0 to the number of units."""
    like = np.zeros((len(bounds) - 1, LIKE), np.uint32)
    first, second = (units & np.uint64(0xFFFF)).astype(np.intp), ((units >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)
    # what lies between two bounds and is summed at once
    cuts = np.union1d(bounds, np.arange(0, len(units), AT_ONCE))
    begins, sums = cuts[:-1].tolist(), np.searchsorted(bounds, cuts[:-1], "right") - 1
    held = -1
    for a, b, to in zip(begins, cuts[1:].tolist(), sums.tolist(), strict=True):
        if a // AT_ONCE != held:
            held = a // AT_ONCE
            here = slice(held * AT_ONCE, (held + 1) * AT_ONCE)
            numbers = _FIRST[first[here]]
            numbers += _SECOND[second[here]]
        like[to] += np.add.reduce(numbers[a - here.start : b - here.start], axis=0, dtype=np.uint32)
    return like


def whole_lanes(paragraphs: list[str]) -> np.ndarray:
    """The lanes of paragraphs as they stand, summed."""
    return np.frombuffer(b"".join([hashlib.blake2b(p.encode(), person=b"paragraph").digest() for p in paragraphs]), "<u4").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)


def likeness_lanes(tokens: np.ndarray, clauses: np.ndarray) -> np.ndarray:
    """The count and the sums of units."""
    number = np.array([(len(tokens) + CLAUSE_WEIGHT * len(clauses)) % 2**32], np.uint32)
    return np.concatenate([number, lanes_of(tokens) + np.uint32(CLAUSE_WEIGHT) * lanes_of(clauses)])


def vectors(paragraphs: list[str]) -> np.ndarray:
    """The sum of the vectors of some paragraphs; uint32 lanes, modulo 2**32."""
    return Units.of(paragraphs).vectors()


def paragraphs_of(text: str) -> list[str]:
    """The lines of a text; the empty text has none."""
    return text.split("\n") if text else []


def fingerprint(text: str) -> np.ndarray:
    return vectors(paragraphs_of(text))


def changed(of: np.ndarray, removed: list[str], added: list[str]) -> np.ndarray:
    """The fingerprint after some paragraphs are taken away and others added."""
    return of - vectors(removed) + vectors(added)


def edited_fingerprint(of: np.ndarray, before: str | Units, after: str) -> np.ndarray:
    """The fingerprint of `after` from that of `before` (its text or its units): only paragraphs behind their common beginning are hashed, only units behind it summed."""
    old, b = Units.of(paragraphs_of(before)) if isinstance(before, str) else before, paragraphs_of(after)
    a = old.paragraphs
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    gone, new = (whole_lanes(a[same:]), *old.after(same)), (whole_lanes(b[same:]), token_units(b[same:]), clause_units(b[same:]))
    kept = [common_beginning(x, y) for x, y in zip(gone[1:], new[1:], strict=True)]
    less, more = (np.concatenate([w, likeness_lanes(t[kept[0] :], c[kept[1] :])]) for w, t, c in (gone, new))
    return of - less + more


def common_beginning(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    apart = np.flatnonzero(x[:n] != y[:n])
    return int(apart[0]) if len(apart) else n


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else an estimate of the share of units in common: twice the shared ones by those of both.

    Its standard error is about a tenth of what isn't shared. Texts may differ in some 60 million units.
    """
    if np.array_equal(a, b):
        return 1.0
    size = int(a[EXACT]) + int(b[EXACT])
    apart = float(np.median(np.abs((a - b)[EXACT + 1 :].view(np.int32).astype(np.float64)))) / SCALE
    return min(1.0, max(0.0, 1.0 - apart / size)) if size else 0.0


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`likeness` of the rows of two arrays of fingerprints."""
    size = a[:, EXACT].astype(np.int64) + b[:, EXACT]
    apart = np.median(np.abs((a - b)[:, EXACT + 1 :].view(np.int32).astype(np.float64)), axis=1) / SCALE
    found = np.where(size > 0, np.clip(1.0 - apart / np.maximum(size, 1), 0.0, 1.0), 0.0)
    return np.where((a == b).all(axis=1), 1.0, found)


def edits(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of texts each of which the next one follows: the edited texts and their fingerprints of all but the last, and the fingerprints of all."""
    cuts = [len(t) - len(t) // 3 for t in texts[:-1]]
    after = [t[:c] + following[: len(t) - c] for t, c, following in zip(texts[:-1], cuts, texts[1:], strict=True)]
    # lines are the same up to that of the cut
    lines = [t.rfind("\n", 0, c) + 1 for t, c in zip(texts[:-1], cuts, strict=True)]
    digests = Digests()
    have, tails = found_in(texts, digests), found_in([a[p:] for a, p in zip(after, lines, strict=True)], digests)
    whole = [(whole_lanes(paragraphs_of(t[: p - 1]) if p > 1 else [""] * p), whole_lanes(t[p:].split("\n") if t else []), whole_lanes(a[p:].split("\n") if a else [])) for t, a, p in zip(texts[:-1], after, lines, strict=True)]
    made = np.zeros((len(texts), EXACT + 1 + LIKE), np.uint32)
    for i, (w, gone, _) in enumerate(whole):
        made[i, :EXACT] = w + gone
    made[-1, :EXACT] = whole_lanes(paragraphs_of(texts[-1]))
    other = made[:-1].copy()
    for i, (_, gone, new) in enumerate(whole):
        other[i, :EXACT] += new - gone
    for weight, of, tail in zip((1, CLAUSE_WEIGHT), have, tails, strict=True):
        # of each text: the unit at which what the edit removes begins; the units that the edited text before it has from it
        gone, shared = of.bounds[1:].copy(), np.repeat(of.bounds[:-1, None], 2, axis=1)
        rest, sizes = [], []
        for i, (c, p) in enumerate(zip(cuts, lines, strict=True)):
            (units, ends), (new, new_ends), (following, following_ends) = of.of(i), tail.of(i), of.of(i + 1)
            begun = int(np.searchsorted(ends, p, "right"))
            same = common_beginning(units[begun:], new)
            gone[i] = of.bounds[i] + begun + same
            x, y, n = in_common(new[same:], new_ends[same:] + (p - c), following, following_ends)
            shared[i + 1] = of.bounds[i + 1] + y, of.bounds[i + 1] + y + n
            rest += [new[same : same + x], new[same + x + n :]]
            sizes.append(len(new) - same - n)
        bounds = np.sort(np.concatenate([of.bounds, gone, shared.ravel()]))
        sums = np.concatenate([np.zeros((1, LIKE), np.uint32), np.cumsum(lanes_between(of.units, bounds), axis=0, dtype=np.uint32)])
        until = lambda at: sums[np.searchsorted(bounds, at)]  # noqa: B023, E731
        more = lanes_between(np.concatenate([np.zeros(0, np.uint64), *rest]), np.cumsum([0, *sizes]))
        all_of = until(of.bounds[1:]) - until(of.bounds[:-1])
        fewer = until(of.bounds[1:-1]) - until(gone[:-1])
        taken = until(shared[1:, 1]) - until(shared[1:, 0])
        made[:, EXACT + 1 :] += np.uint32(weight) * all_of
        other[:, EXACT + 1 :] += np.uint32(weight) * (all_of[:-1] - fewer + taken + more)
        number = np.diff(of.bounds)
        made[:, EXACT] += (weight * number).astype(np.uint32)
        new_number = gone[:-1] - of.bounds[:-2] + shared[1:, 1] - shared[1:, 0] + np.array(sizes, np.int64)
        other[:, EXACT] += (weight * new_number).astype(np.uint32)
    return after, other, made


def in_common(new: np.ndarray, new_ends: np.ndarray, old: np.ndarray, old_ends: np.ndarray) -> tuple[int, int, int]:
    """Where units that end at the same places begin to be the same ones, in `new` and in `old`, and how many are, one behind another.

    A unit reaches back over few tokens, so behind a cut the same ones begin soon or not at all.
    """
    a = int(np.searchsorted(new_ends, 1))
    some = slice(a, a + 4 * BEFORE)
    at = np.searchsorted(old_ends, new_ends[some])
    near = np.minimum(at, len(old) - 1)
    same = np.flatnonzero((old_ends[near] == new_ends[some]) & (old[near] == new[some])) if len(old) else at[:0]
    if not len(same):
        return len(new), 0, 0
    x, y = a + int(same[0]), int(near[same[0]])
    return x, y, common_beginning(new[x:], old[y:])


def written(of: np.ndarray) -> str:
    return base64.b64encode(of.astype("<u4").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row. Null text counts as empty; ids may be null or repeat; an empty table gives no rows."""
    schema = pa.schema([("id", pa.int64()), ("fingerprint", pa.string())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([written(fingerprint(t)) for t in batch["text"].to_pylist()], pa.string())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, fingerprint string").withColumnRenamed("id", id_col)


def in_descending_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, ahead) dealt by ranges of ids, each partition in descending order of ids.

    The rows with `ahead` at a partition's end are copies of those that begin the next range; after the
    last range comes the first one. Only the quantiles of the ids and the largest id of each range reach
    the driver. Of equal ids the least text comes first; null ids come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    parts = partitions(docs.sparkSession)
    rows = rows.withColumn("range", range_of(F.col("id"), cuts_of(rows.select("id").filter("id is not null"), "id", parts)))
    firsts = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.max("id").alias("first")).collect()}
    held = sorted(firsts)
    # a range's first row is also what follows the last row of the range above it
    above = {k: held[(i + 1) % len(held)] for i, k in enumerate(held)}
    every = range(max(held, default=0) + 1)
    first = F.get(F.array(*[F.lit(firsts.get(k)).cast("long") for k in every]), F.col("range"))
    to = F.get(F.array(*[F.lit(above.get(k)).cast("int") for k in every]), F.col("range"))
    place = lambda at, ahead: F.struct(at.cast("int").alias("at"), F.lit(ahead).alias("ahead"))
    own, copy = place(F.col("range"), False), place(to, True)
    dealt = rows.withColumn("place", F.explode(F.when(F.col("id").eqNullSafe(first), F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select("id", "text", "place.at", "place.ahead").repartitionById(len(every), F.col("at"))
    return dealt.sortWithinPartitions("ahead", F.col("id").desc_nulls_last(), "text").select("id", "text", "ahead")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its fingerprint and that of its edited text.

    Edited: the last third of the code points (rounded down) gives way to as many from the beginning of
    the next row in descending order of ids, or to all of it; after the last row comes the first. Null
    text counts as empty; null ids come last; of equal ids the least text comes first; an only row
    follows itself; an empty table gives no rows. Other columns don't matter.
    """
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []  # id and text of the row that still lacks its next one
        for batch in by_size(batches, "text"):
            rows = [*last, *zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["ahead"].to_pylist(), strict=True)]
            # rows ahead stand at the end; only the first of them follows a row, if there is one
            own = sum(not r[2] for r in rows)
            rows = rows[: own + 1] if own else []
            last = rows[-1:] if own == len(rows) else []
            ids, texts = [r[0] for r in rows[:-1]], [r[1] for r in rows]
            if not ids:
                continue
            after, other, of = edits(texts)
            columns = ids, [len(t) for t in texts[:-1]], [hashlib.sha256(a.encode()).hexdigest() for a in after], [written(x) for x in of[:-1]], [written(x) for x in other], likenesses(of[:-1], other), likenesses(of[:-1], of[1:])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    made = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(docs, id_col, text_col).mapInArrow(work, made).withColumnRenamed("id", id_col)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))

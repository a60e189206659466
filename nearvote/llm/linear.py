"""Text features counted by Spark, and logistic regression on a bounded sample of labelled rows.

Features of a text: its words (A-Z and other letters lowered), the beginnings of its words, and marks of
its form. Each is a share of the text or the logarithm of a count, so texts of any length compare.
Which ones a model looks at is chosen on the sample; scoring then needs a table of some hundred
strings, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearvote.llm.common import by_size, filled

if TYPE_CHECKING:
    import pandas as pd

WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features.
BEGINNINGS = (5, 6, 7)
#: Features that a model has at most.
MOST_FEATURES = 300


#: Characters of a long text that are looked at together.
PIECE = 1 << 16
SPACE = re.compile(r"\s")


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut before white space, so that a long one never stands as one list of words."""
    at = 0
    while len(text) - at > PIECE:
        cut = SPACE.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def counts_of(text: str, known: frozenset[str] | None = None) -> tuple[dict[str, int], int]:
    """How often each word and each beginning ("x~") stands in a text, and the number of words; of `known` ones if given."""
    found: dict[str, int] = {}
    number = 0
    for piece in pieces(text):
        words = WORDS.findall(piece.lower())
        number += len(words)
        if known is None:
            for w in words:
                found[w] = found.get(w, 0) + 1
            continue
        for w in words:
            if w in known:
                found[w] = found.get(w, 0) + 1
            for k in BEGINNINGS:
                if len(w) >= k and (b := f"{w[:k]}~") in known:
                    found[b] = found.get(b, 0) + 1
    if known is None:
        for w, n in list(found.items()):
            for k in BEGINNINGS:
                if len(w) >= k:
                    found[f"{w[:k]}~"] = found.get(f"{w[:k]}~", 0) + n
    return found, number


def weighed(count: int, words: int) -> tuple[float, float]:
    """What a count is worth: its logarithm, and its share of the words on a logarithmic scale."""
    return float(np.log1p(count)), float(np.log1p(1000.0 * count / max(words, 50)))


FORMS = ("bar", "sign", "upper", "digit", "repeat", "mean", "lines", "size")


def form(text: str) -> list[float]:
    """Shares and sizes that tell how a text is written."""
    raw, n, same, last = np.zeros(256, np.int64), 0, 0, None
    for piece in pieces(text):
        raw += np.bincount(np.frombuffer(piece.encode(), np.uint8), minlength=256)
        words = piece.split()
        same += sum(map(eq, words, words[1:])) + bool(words and words[0] == last)
        n, last = n + len(words), words[-1] if words else last
    n, number, chars = max(n, 1), n, max(len(text), 1)
    letters = raw[65:91].sum() + raw[97:123].sum() + raw[0xC0:].sum()
    share = lambda x: float(np.log1p(20.0 * x))
    return [
        share(raw[ord("|")] / n), share(raw[list(b"%&$#*~^!")].sum() / n), share(raw[65:91].sum() / max(letters, 1)), share(raw[48:58].sum() / chars),
        share(same / n), min(chars / n, 40.0) / 10, share(raw[10] / n), float(np.log1p(number)) / 10,
    ]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Linear:
    """Weights on standardized columns, and a constant."""

    weights: np.ndarray
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.constant)


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12, weight: np.ndarray | None = None) -> Linear:
    """Logistic regression with an L2 penalty on standardized columns, by Newton steps. One class only: a constant."""
    w = np.ones(len(y)) if weight is None else weight
    if len(y) == 0 or y.min() == y.max():
        return Linear(np.zeros(x.shape[1]), 0.0 if len(y) == 0 else float(np.where(y[0] > 0, 5.0, -5.0)))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.concatenate([(x - mean) / spread, np.ones((len(y), 1))], axis=1)
    keep = np.full(z.shape[1], penalty)
    keep[-1] = 1e-6
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ b)
        gradient = z.T @ (w * (p - y)) + keep * b
        h = (z * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z
        h[np.diag_indices_from(h)] += keep
        step = np.linalg.solve(h, gradient)
        b -= step
        if np.abs(step).max() < 1e-3:
            break
    weights = b[:-1] / spread
    return Linear(weights, float(b[-1] - mean @ weights))


# ---- in Spark


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, id_col: str, text_col: str, carry: tuple = (), seed: int = 5) -> DataFrame:
    """At most `most` labelled documents, by a seeded order of ids, checkpointed: doc_id, text, y array<double> (null: unlabelled in that column), carry.

    Of labels repeated under one id the largest counts. Labels without an id, without a document or null
    in all columns don't count, and don't use up the limit.
    """
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*[F.max(c).cast("double").alias(f"y{i}") for i, c in enumerate(columns)])
    ys = [F.col(f"y{i}") for i in range(len(columns))]
    known = known.filter(F.coalesce(*ys).isNotNull()).join(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", "left_semi")
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).select("doc_id", F.array(*ys).alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"), *carry)
    return rows.join(F.broadcast(drawn), "doc_id").checkpoint()  # bounded: `most` rows of two columns


def telling(sample: DataFrame, column: int, most: int, least: int = 4) -> DataFrame:
    """The features that tell most about y[column]: name and purity, the share of texts with it whose label is 1.

    By the likelihood ratio of the label among texts that have the feature and among all. Counted and
    ranked in Spark; at most `most` rows.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                found = list(counts_of(text)[0])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.float64())], names=["name", "y"])

    rows = sample.select("text", F.get("y", F.lit(column)).alias("y")).filter("y is not null")
    rate = rows.agg(F.least(F.greatest(F.avg("y"), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("rate"))
    seen = rows.mapInArrow(work, "name string, y double").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a")).filter(F.col("n") >= least)
    p = F.least(F.greatest(F.col("a") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9))
    gain = F.col("n") * (p * F.log(p / F.col("rate")) + (1 - p) * F.log((1 - p) / (1 - F.col("rate"))))
    scored = seen.withColumn("rate", rate.scalar()).withColumns({"gain": gain, "purity": F.col("a") / F.col("n")})
    return scored.filter("gain > 2").orderBy(F.desc("gain"), "name").limit(most).select("name", "purity")


def telling_by_fold(sample: DataFrame, column: int, most: int, folds: int, least: int = 4) -> list[list[str]]:
    """What `telling` names for the sample without each fold (of `folds_of` ids), and last for all of it.

    Texts are counted once, by feature and fold; what reaches the driver is at most `most` names a fold.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            of = folds_of(batch["doc_id"].to_numpy(), folds)
            for text, y, fold in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), of.tolist(), strict=True):
                found = [*counts_of(text)[0], ""]  # the empty name stands for the text itself
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.float64()), pa.array([fold] * len(found), pa.int32())], names=["name", "y", "fold"])

    rows = sample.select("doc_id", "text", F.get("y", F.lit(column)).alias("y")).filter("y is not null").mapInArrow(work, "name string, y double, fold int")
    kept = [F.lit(True) if k == folds else F.col("fold") != k for k in range(folds + 1)]
    seen = rows.groupBy("name").agg(*[f.alias(f"{c}{k}") for k, of in enumerate(kept) for c, f in (("n", F.count_if(of)), ("a", F.sum(F.when(of, F.col("y")).otherwise(0.0))))]).checkpoint()
    every = seen.filter("name = ''").first()
    chosen = []
    for k in range(folds + 1):
        if every is None or not every[f"n{k}"]:
            chosen.append([])
            continue
        rate = min(max(every[f"a{k}"] / every[f"n{k}"], 1e-6), 1 - 1e-6)
        p = F.least(F.greatest(F.col(f"a{k}") / F.col(f"n{k}"), F.lit(1e-9)), F.lit(1 - 1e-9))
        gain = F.col(f"n{k}") * (p * F.log(p / rate) + (1 - p) * F.log((1 - p) / (1 - rate)))
        top = seen.filter((F.col(f"n{k}") >= least) & (F.col("name") != "")).withColumn("gain", gain).filter("gain > 2").orderBy(F.desc("gain"), "name").limit(most)
        chosen.append(sorted(r["name"] for r in top.select("name").collect()))
    return chosen


def collected(sample: DataFrame, names: list[str], carry: tuple[str, ...] = ()) -> pd.DataFrame:
    """The sample's features on the driver, sorted by id: doc_id, y, at and n (places and counts of the known features), words, form, carry."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = {f: i for i, f in enumerate(names)}, frozenset(names)
        for batch in by_size(batches, "text"):
            texts = batch["text"].to_pylist()
            found = [counts_of(t, known) for t in texts]
            held = {n: batch[n] for n in batch.schema.names if n != "text"}
            held |= {
                "at": pa.array([[at[f] for f in c] for c, _ in found], pa.list_(pa.int32())), "n": pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32())),
                "words": pa.array([w for _, w in found], pa.int32()), "form": pa.array([form(t) for t in texts], pa.list_(pa.float64())),
            }
            yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held))

    made = f"{sample.drop('text')._jdf.schema().toDDL()}, at array<int>, n array<int>, words int, form array<double>"
    pdf = sample.select(*[c for c in sample.columns if c != "text"], "text").mapInArrow(work, made).toPandas()
    return pdf.sort_values("doc_id", kind="stable", ignore_index=True)


def matrix(at: Iterable, n: Iterable, words: Iterable[int], forms: Iterable, features: int) -> np.ndarray:
    """A row for each text: two columns for each feature, then the marks of form."""
    forms = np.array([*forms], np.float64).reshape(-1, len(FORMS))
    x = np.zeros((len(forms), 2 * features + len(FORMS)))
    x[:, 2 * features :] = forms
    for r, (a, k, w) in enumerate(zip(at, n, words, strict=True)):
        for i, c in zip(a, k, strict=True):
            x[r, 2 * i : 2 * i + 2] = weighed(c, w)
    return x


def text_matrix(texts: list[str], at: dict[str, int], known: frozenset[str]) -> np.ndarray:
    found = [counts_of(t, known) for t in texts]
    return matrix([[at[f] for f in c] for c, _ in found], [list(c.values()) for c, _ in found], [w for _, w in found], [form(t) for t in texts], len(at))


def folds_of(ids: np.ndarray, k: int) -> np.ndarray:
    """The fold of each id, the same on every run."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % k

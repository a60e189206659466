"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear model gets the probabilities of the earlier
categories beside the features of the text. In training those probabilities are out-of-fold: a row's
come from models that haven't seen it, nor were their features chosen on it, so that later models learn how
far earlier ones can be relied on, and the threshold is taken on rows that are new to the models. All models
are fitted on a bounded sample of labelled rows; all texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.common import by_size, filled, table
from nearvote.llm.linear import FORMS, Linear, collected, fitted, folds_of, labelled_sample, matrix, telling_by_fold, text_matrix

#: Labelled rows that the models are fitted on, at most.
MOST_LABELLED = 6000
#: Features that are chosen for each category, and folds of the out-of-fold predictions.
FEATURES, FOLDS = 120, 4
#: The categories in order: name, column of the labels, and the value there that is the category.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


@dataclass(frozen=True)
class Chain:
    """Features, categories in order with a model each, and the probability of the last from which a text is rejected."""

    names: list[str]
    categories: list[str]
    models: list[Linear]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        found = np.zeros((len(x), 0))
        for model in self.models:
            found = np.column_stack([found, model.score(np.column_stack([x, logit(found)]))])
        return found


def logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit_chain(x: np.ndarray, ys: list[np.ndarray], ids: np.ndarray, names: list[str], categories: list[str], folds: int = FOLDS, penalty: float = 3.0, chosen: list[np.ndarray] | None = None) -> Chain:
    """One model for each category, in order. `ys`: 0 or 1, or NaN for rows that a category doesn't learn from.

    chosen: which columns of x the models of each fold may look at, and last those of the chain itself; all, if
    not given. The threshold is where the out-of-fold predictions of the last category have the best F1, the middle
    between the neighbours there; above 1 if the sample has no positive row.
    """
    fold, earlier, models = folds_of(ids, folds), np.zeros((len(x), 0)), []
    chosen = chosen or [np.ones(x.shape[1], bool)] * (folds + 1)
    for y in ys:
        known = ~np.isnan(y)
        z = lambda k, of, earlier=earlier: np.column_stack([x[of][:, chosen[k]], logit(earlier[of])])
        out = np.zeros(len(x))
        for k in range(folds):
            out[fold == k] = fitted(z(k, known & (fold != k)), y[known & (fold != k)], penalty).score(z(k, fold == k))
        models.append(fitted(z(folds, known), y[known], penalty))
        earlier = np.column_stack([earlier, out])
    known = ~np.isnan(ys[-1])
    return Chain(names, categories, models, best_threshold(earlier[known, -1] if len(x) else np.zeros(0), ys[-1][known]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    if not y.sum():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.flatnonzero(f1 == f1.max())[-1])
    return float((p[order[at]] + (p[order[at + 1]] if at + 1 < len(p) else 0.0)) / 2)


def toxicity_chain(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str, int], ...] = CATEGORIES, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain of the given categories, low_quality and then toxic by default; texts are rejected by the last.

    Each category has its own labels, which rows may lack. The features that tell most about each are chosen
    on the labelled sample, for the models of a fold without that fold. Without labelled rows all
    probabilities are near 0 and nothing is rejected.
    """
    sample = labelled_sample(docs, labels, [column for _, column, _ in categories], most, id_col, text_col)
    found = [telling_by_fold(sample, i, FEATURES, FOLDS) for i in range(len(categories))]
    by_fold = [set().union(*(of[k] for of in found)) for k in range(FOLDS + 1)]
    names = sorted(set().union(*by_fold))
    got = collected(sample, names)
    x = matrix(got["at"], got["n"], got["words"], got["form"], len(names))
    chosen = [np.concatenate([np.repeat([n in of for n in names], 2), np.ones(len(FORMS), bool)]) if names else np.ones(len(FORMS), bool) for of in by_fold]
    ys = [np.array([np.nan if v[i] is None else float(v[i] == value) for v in got["y"]], np.float64) for i, (_, _, value) in enumerate(categories)]
    return fit_chain(x, ys, got["doc_id"].to_numpy(), sorted(by_fold[-1]), [name for name, _, _ in categories], chosen=chosen)


def scored(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, a probability p_<category> for each category, and rejected: the last one reaches the threshold.

    Null text counts as empty; null and repeated ids stay, one row out for each row in; an empty table
    gives no rows; other columns don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    schema = pa.schema([("id", pa.int64()), *[(f"p_{c}", pa.float64()) for c in chain.categories], ("rejected", pa.bool_())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        at, known = {f: i for i, f in enumerate(c.names)}, frozenset(c.names)
        for batch in by_size(batches, "text"):
            p = c.score(text_matrix(batch["text"].to_pylist(), at, known))
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= c.threshold)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    made = "id long, " + "".join(f"p_{c} double, " for c in chain.categories) + "rejected boolean"
    return rows.mapInArrow(work, made).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the chain doesn't reject, with all their columns, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        at, known = {f: i for i, f in enumerate(c.names)}, frozenset(c.names)
        for batch in by_size(batches, text_col):
            p = c.score(text_matrix([t or "" for t in batch[text_col].to_pylist()], at, known))
            yield batch.filter(pa.array(p[:, -1] < c.threshold))

    return docs.mapInArrow(work, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, toxicity_chain(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("rejected", "toxic")

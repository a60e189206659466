"""Quality by co-training: a classifier of the text and one of what is known about the page.

Both start from the labelled rows. In each round either gives the other all unlabelled rows of the corpus
that it is sure of, with its answer as the label; of these the more frequent class counts less, so that
both weigh in proportion as in the labelled rows. Models are fitted by Newton steps, whose sums over the
unlabelled rows Spark adds up.
How sure a view is says its calibration on labelled rows that neither has been fitted on; so a view that
tells nothing hands nothing over. In the end the calibrated log odds are added up, less those of the
classes' proportion: such a view then has no say either. Only labelled
rows are a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearvote.llm.common import by_size, filled, stored, table
from nearvote.llm.linear import Linear, collected, fitted, folds_of, labelled_sample, matrix, sigmoid, telling, text_matrix
from nearvote.llm.toxicity import logit

#: Labelled rows that the models see, at most.
MOST_LABELLED = 5000
FEATURES, ROUNDS = 60, 3
#: How sure a view must be of a row that it hands over; the weight that both classes may have together in any proportion.
SURE, HANDED = 0.97, 400
#: Newton steps of a round at most.
STEPS = 6
#: Tasks that add up the sums of the others.
SUMMING = 8
#: Slots that sources and languages hash to.
SLOTS = 32


def page_matrix(lang: Iterable, source: Iterable, n_chars: Iterable) -> np.ndarray:
    """What is known about a page beside its text: hashed source and language, and its size. Nulls have slots of their own."""
    rows = []
    for a, s, n in zip(lang, source, n_chars, strict=True):
        row = np.zeros(2 * SLOTS + 3)
        row[zlib.crc32(repr(("lang", a)).encode()) % SLOTS] = 1
        row[SLOTS + zlib.crc32(repr(("source", s)).encode()) % SLOTS] = 1
        size = float(n) if n is not None and n == n and n > 0 else 0.0
        row[-3:] = np.log1p(size) / 10, float(size < 200), float(size > 20_000)
        rows.append(row)
    return np.array(rows).reshape(-1, 2 * SLOTS + 3)


@dataclass(frozen=True)
class Views:
    """Both views' models with their calibration on the log odds, and the log odds of a good row among all."""

    names: list[str]
    models: tuple[Linear, Linear]
    calibration: tuple[Linear, Linear]
    prior: float

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of either view, and of both."""
        p = [c.score(logit(m.score(x))[:, None]) for m, x, c in zip(self.models, (text, page), self.calibration, strict=True)]
        return p[0], p[1], sigmoid(logit(p[0]) + logit(p[1]) - self.prior)


@dataclass(frozen=True)
class Round:
    """What a pass over unlabelled rows needs: the calibrated models of all rounds so far, and for each view the weights to go on from, on columns less their mean and by their spread."""

    scorers: list[tuple[tuple[Linear, Linear], tuple[Linear, Linear]]]
    weights: tuple[np.ndarray, np.ndarray]
    means: tuple[np.ndarray, np.ndarray]
    spreads: tuple[np.ndarray, np.ndarray]

    def standard(self, v: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.means[v]) / self.spreads[v], np.ones((len(x), 1))], axis=1)

    def width(self, v: int) -> int:
        return len(self.weights[v])

    def empty(self) -> np.ndarray:
        return np.zeros(sum(2 * (1 + d + d * d) for d in (self.width(0), self.width(1))))

    def handed(self, views: tuple[np.ndarray, np.ndarray], v: int) -> np.ndarray:
        """The labels that view v has from the other: of the first round in which that was sure; NaN: of none."""
        label, x = np.full(len(views[v]), np.nan), views[1 - v]
        for models, calibration in self.scorers:
            p = calibration[1 - v].score(logit(models[1 - v].score(x))[:, None])
            free = np.isnan(label)
            label[free & (p >= SURE)] = 1.0
            label[free & (p <= 1 - SURE)] = 0.0
        return label

    def sums(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """For each view and class the rows handed over: their number, gradient and Hessian, one after another."""
        views, out = (text, page), []
        for v in (0, 1):
            label = self.handed(views, v)
            for c in (0.0, 1.0):
                z = self.standard(v, views[v][label == c])
                p = sigmoid(z @ self.weights[v])
                out += [[len(z)], z.T @ (p - c), ((z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z).ravel()]
        return np.concatenate(out)

    def parts(self, sums: np.ndarray, good: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of either view the gradient and Hessian of both classes, weighed to the proportion of the labelled rows."""
        found, at = [], 0
        for v in (0, 1):
            d, of = self.width(v), []
            for _ in range(2):
                of.append((sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
                at += 1 + d + d * d
            share = (1 - good, good)
            both = max(HANDED, min(n / s for (n, _, _), s in zip(of, share, strict=True)))
            w = [min(1.0, both * s / n) if n else 0.0 for (n, _, _), s in zip(of, share, strict=True)]
            found.append((w[0] * of[0][1] + w[1] * of[1][1], w[0] * of[0][2] + w[1] * of[1][2]))
        return found


def co_trained(text: np.ndarray, page: np.ndarray, y: np.ndarray, ids: np.ndarray, names: list[str], rounds: int = ROUNDS, penalty: float = 3.0, over: Callable[[Round], np.ndarray] | None = None) -> Views:
    """y: 1 good, 0 bad, NaN unlabelled; `over` adds up Round.sums of more unlabelled rows. A third of the labelled rows is kept for calibration."""
    views, known = (text, page), ~np.isnan(y)
    held = known & (folds_of(ids, 3) == 0)
    first = known & ~held

    def calibrated(model: Linear, x: np.ndarray) -> Linear:
        return fitted(logit(model.score(x[held]))[:, None], y[held], 1.0)

    if held.sum() < 2 or np.ptp(y[held]) == 0:
        held = first
    good = float(np.clip(y[known].mean(), 0.001, 0.999)) if known.any() else 0.5
    models = tuple(fitted(x[first], y[first], penalty) for x in views)
    if first.any() and np.ptp(y[first]) > 0:
        means = tuple(x[first].mean(axis=0) for x in views)
        spreads = tuple(np.where((s := x[first].std(axis=0)) < 1e-9, 1.0, s) for x in views)
        scorers: list = []
        for _ in range(rounds):
            scorers = [*scorers, (models, tuple(calibrated(m, x) for m, x in zip(models, views, strict=True)))]
            weights = [np.append(m.weights * s, m.constant + mean @ m.weights) for m, s, mean in zip(models, spreads, means, strict=True)]
            for _ in range(STEPS):
                now, moved = Round(scorers, tuple(weights), means, spreads), 0.0
                sums = now.sums(text[~known], page[~known]) + (over(now) if over else 0.0)
                for v, (gradient, h) in enumerate(now.parts(sums, good)):
                    z = now.standard(v, views[v][first])
                    p, keep = sigmoid(z @ weights[v]), np.append(np.full(views[v].shape[1], penalty), 1e-6)
                    gradient = gradient + z.T @ (p - y[first]) + keep * weights[v]
                    h = h + (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + np.diag(keep)
                    step = np.linalg.solve(h, gradient)
                    weights[v] = weights[v] - step
                    moved = max(moved, float(np.abs(step).max()))
                if moved < 0.01:
                    break
            models = tuple(Linear(w[:-1] / s, float(w[-1] - mean @ (w[:-1] / s))) for w, s, mean in zip(weights, spreads, means, strict=True))
    return Views(names, tuple(models), tuple(calibrated(m, x) for m, x in zip(models, views, strict=True)), float(logit(np.array(good))))


def quality_views(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", page: tuple[str, str, str] = ("lang", "source", "n_chars")) -> Views:
    """Both views fitted on at most `most` labelled rows, by a seeded order of ids, and on all other rows of `docs`."""
    carry = tuple(F.col(c).alias(n) for c, n in zip(page, ("lang", "source", "n_chars"), strict=True))
    labelled = labelled_sample(docs, labels, [label], most, id_col, text_col, carry)
    names = sorted(r["name"] for r in telling(labelled, 0, FEATURES).collect())
    got = collected(labelled, names)
    y = np.array([v[0] if v[0] is not None else np.nan for v in got["y"]], np.float64)
    others = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"), *carry)
    others = others.join(F.broadcast(labelled.select("doc_id").distinct()), "doc_id", "left_anti")  # bounded: `most` ids
    kept = unlabelled_matrices(others, names)
    return co_trained(matrix(got["at"], got["n"], got["words"], got["form"], len(names)), page_matrix(got["lang"], got["source"], got["n_chars"]), y, got["doc_id"].to_numpy(np.int64), names, over=lambda now: summed(kept, now))


def unlabelled_matrices(rows: DataFrame, names: list[str]) -> DataFrame:
    """Both views' columns of each row, as 32-bit numbers, written once: text and page."""
    schema = pa.schema([("text", pa.binary()), ("page", pa.binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = {f: i for i, f in enumerate(names)}, frozenset(names)
        for batch in by_size(batches, "text"):
            both = text_matrix(batch["text"].to_pylist(), at, known), page_matrix(*[batch[c].to_pylist() for c in ("lang", "source", "n_chars")])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()) for x in both], schema=schema)

    return stored(rows.select("text", "lang", "source", "n_chars").mapInArrow(work, "text binary, page binary"), "unlabelled")


def summed(rows: DataFrame, now: Round) -> np.ndarray:
    """Round.sums over all rows. Tasks add up theirs, some tasks add up those, and the driver gets one row of each of the latter."""
    held = rows.sparkSession.sparkContext.broadcast(now)

    def of_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        total = r.empty()
        for batch in batches:
            x = [np.frombuffer(b"".join(batch[c].to_pylist()), np.float32).reshape(batch.num_rows, r.width(v) - 1).astype(np.float64) for v, c in enumerate(("text", "page"))]
            total += r.sums(*x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def of_tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = held.value.empty()
        for batch in batches:
            for x in batch["sums"]:
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    few = rows.mapInArrow(of_rows, "sums binary").repartition(SUMMING).mapInArrow(of_tasks, "sums binary").collect()
    return sum((np.frombuffer(r["sums"], np.float64) for r in few), now.empty())


def scored(docs: DataFrame, views: Views, id_col: str = "doc_id", text_col: str = "text", page: tuple[str, str, str] = ("lang", "source", "n_chars"), least: float = 0.5) -> DataFrame:
    """Each row's id, p_text and p_page (calibrated), quality (combined), and kept: quality reaches `least`.

    Null text counts as empty, nulls in the page's columns are values of their own. Null and repeated ids
    stay, one row out for each row in; an empty table gives no rows; other columns don't matter. Without
    labelled rows all scores are alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(views)
    schema = pa.schema([("id", pa.int64()), ("p_text", pa.float64()), ("p_page", pa.float64()), ("quality", pa.float64()), ("kept", pa.bool_())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        at, known = {f: i for i, f in enumerate(v.names)}, frozenset(v.names)
        for batch in by_size(batches, "text"):
            x = text_matrix(batch["text"].to_pylist(), at, known)
            t, p, q = v.score(x, page_matrix(*[batch[c].to_pylist() for c in ("lang", "source", "n_chars")]))
            yield pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, (t, p, q, q >= least))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(page, ("lang", "source", "n_chars"), strict=True)])
    return rows.mapInArrow(work, "id long, p_text double, p_page double, quality double, kept boolean").withColumnRenamed("id", id_col)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, quality_views(docs, table(spark, sf_dir, "labels")))

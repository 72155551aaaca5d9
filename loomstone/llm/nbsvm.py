"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of word n-grams and word ends are scaled by the classes' log-count ratios and brought to
unit length; a linear hinge-loss model is fitted by dual coordinate descent; a held-back fifth of the
sample calibrates its margin to a probability. The model is fitted on a bounded sample: at most
`per_class` labelled rows of each class, by hash order. Scoring reads every whole text.

Null and empty texts have no indicators: their score is that of margin = bias. With no labelled rows,
or one class only, every score is the smoothed share of label 1. Repeated rows score alike; rows with a
null doc_id are scored like others, are in no fold (held_out is null) and never learnt from. Ties: equal
scores are not ordered; a doc_id labelled several times counts with its largest label, and the sample
takes rows by (hash of doc_id, doc_id). An empty table gives an empty result; other columns of the input
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import docs_of, fold, map_batches, slices
from loomstone.llm.features import calibration, indicators, labelled_rows, logistic

BITS = 18
PER_CLASS = 3000
TAILS = (1, 3)
LEAST_SEEN = 5  # rows of the sample that hold a feature, for it to count


@dataclass
class Model:
    scaled: np.ndarray  # ratio * weight of each feature
    square: np.ndarray  # ratio ** 2 of each feature
    bias: float
    a: float
    b: float

    def margin(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(row, weights=self.square[feature], minlength=n))
        total = np.bincount(row, weights=self.scaled[feature], minlength=n)
        return total / np.maximum(norm, 1e-12) + self.bias

    def score(self, column: pa.Array) -> np.ndarray:
        return logistic(self.a * self.margin(*indicators(column, BITS, tails=TAILS, wanted=self.square > 0), len(column)) + self.b)


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, c: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model, by dual coordinate descent.

    x: (features, values) per row, to which a constant 1 is added; c: the bound of each row's multiplier.
    """
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    sign = 2.0 * y - 1
    square = np.array([v @ v + 1 for _, v in x])
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, v = x[i]
            gradient = sign[i] * (w[f] @ v + w[dim]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                moved = max(moved, abs(step))
                w[f] += step * v
                w[dim] += step
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def log_ratios(rows: list[tuple[np.ndarray, int]], dim: int, smooth: float = 1.0) -> np.ndarray:
    """Each feature's smoothed share of the rows of class 1 over that of class 0, as a logarithm; 0 for
    features of under LEAST_SEEN rows. rows: (distinct features, label)."""
    counts, n = np.full((2, dim), smooth), np.zeros(2)
    for f, label in rows:
        counts[label, f] += 1
        n[label] += 1
    ratio = np.log((counts[1] / (n[1] + 2 * smooth)) / (counts[0] / (n[0] + 2 * smooth)))
    ratio[counts.sum(0) < 2 * smooth + LEAST_SEEN] = 0
    return ratio


def fit(rows: list[tuple[np.ndarray, int, float]], dim: int = 1 << BITS, smooth: float = 1.0) -> Model:
    """The model of (features, label, weight) rows."""
    y = np.array([r[1] for r in rows])
    weight = np.array([r[2] for r in rows])
    share = (weight[y == 1].sum() + 1) / (weight.sum() + 2) if len(rows) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(dim), np.zeros(dim), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    n = np.array([(y[~held] == k).sum() for k in (0, 1)])
    ratio = log_ratios([r[:2] for r, out in zip(rows, held, strict=True) if not out], dim, smooth)
    model = Model(np.zeros(dim), ratio**2, 0.0, 1.0, 0.0)
    x = []
    for f, _, _ in rows:
        v = ratio[f]
        x.append((f, v / max(np.sqrt(v @ v), 1e-12)))
    inside = np.flatnonzero(~held)
    balance = len(inside) / (2 * np.maximum(n, 1))
    w = descend([x[i] for i in inside], y[inside], dim, 4.0 * balance[y[inside]])
    model.scaled, model.bias = ratio * w[:dim], float(w[dim])
    margin = np.array([w[f] @ v + w[dim] for f, v in x])
    use = held if held.any() else ~held
    model.a, model.b = calibration(margin[use], y[use], weight[use])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """The model of at most per_class labelled rows of each class; only their distinct features are collected."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, feature = indicators(batch.column(1), BITS, tails=TAILS)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [feature[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(batch.num_rows)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(packed, pa.binary())], ["doc_id", "y", "weight", "f"])

        return step

    rows = labelled_rows(docs_of(docs), labels, label, (per_class, per_class)).select("doc_id", "text", "y", F.col("weight").cast("double").alias("weight"))
    got = map_batches(rows, make, "doc_id long, y int, weight double, f binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["f"]))
    return fit([(np.frombuffer(r["f"], dtype="<u4").astype(np.int64), r["y"], r["weight"]) for r in got])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in 0..1, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS features

    def make():
        held = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.score(batch.column(1)), pa.float64())], ["doc_id", "score"])

        return step

    return map_batches(docs_of(docs), make, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never read."""
    learn = labels.filter(fold(mod) != held_out)
    found = scores(docs, train(docs, learn))
    return found.select("doc_id", (fold(mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """docs that score at least `threshold`, with all their columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))
    schema = docs.schema

    def run(batches):
        model = shared.value
        at = schema.fieldNames().index("text")
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(batch.column(at).cast(pa.string())) >= threshold))

    return docs.mapInArrow(run, schema)

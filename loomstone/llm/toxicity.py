"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first bytes, by 64-bit hashes. A bounded sample of labelled rows (`toxic_rows` and
`clean_rows` at most, by hash order) gives the examples, and the terms that set the labels apart: all that
pass a chi-square test at LEAST_CHI with LEAST_SEEN examples or more, however many they are. Document
frequencies of these terms are counted over all documents. Examples lie in blocks. Query terms are read from the
highest possible contribution down; the k-th best partial sum is a threshold, and for each block the
largest weights of the terms not yet read bound what its examples can still gain. Examples that can't
reach the threshold are left, the others are scored in full, so the nearest are exact. Votes are weighted
by distance, and calibrated on the examples with each left out of its own vote.

Ties between examples go to the earlier in the index. Null, empty and term-free texts have no
neighbours and score as the calibration of no vote. Without labelled rows, or with one class only,
every score is the smoothed share of label 1. Repeated rows score alike; rows with a null doc_id are
scored like others, are in no fold (held_out is null) and never learnt from. An empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import docs_of, fold, map_batches, slices, written
from loomstone.llm.features import calibration, hashed, labelled_rows, logistic

HEADS, GATE = (4, 5, 6, 7), 18
NEIGHBOURS, BLOCK = 24, 64
LEAST_CHI, LEAST_SEEN = 25.0, 5  # what chance gives to one term in two million, as hundreds of thousands are tested; and the examples it needs to mean anything
TOXIC_ROWS, CLEAN_ROWS = 2000, 6000
NEAREST_FLOOR = 0.05  # added to the distance, so that an equal text has a finite weight


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the positions starts[i]..ends[i] of all i in a row, how many each)."""
    length = ends - starts
    return np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum())), length


@dataclass
class Terms:
    """Chosen terms, as ascending 64-bit hashes; the gate over their first bits lets most others go early."""

    hashes: np.ndarray
    gate: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.gate = np.zeros(1 << GATE, dtype=bool)
        self.gate[(self.hashes >> np.uint64(64 - GATE)).astype(np.int64)] = True

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count), ascending."""
        keys = [np.zeros(0, dtype=np.int64)]
        for h, row in hashed(column, heads=HEADS, pairs=False):
            ok = self.gate[(h >> np.uint64(64 - GATE)).astype(np.int64)]
            h, row = h[ok], row[ok]
            at = np.searchsorted(self.hashes, h)
            ok = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
            keys.append(row[ok] * len(self.hashes) + at[ok])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        size = max(1, len(self.hashes))
        return key // size, key % size, count


@dataclass
class Index:
    """Examples in blocks of BLOCK: vectors by example, postings by term, largest weights by term and block."""

    terms: Terms
    idf: np.ndarray
    ids: np.ndarray  # doc_id of each example
    label: np.ndarray
    share: np.ndarray  # weight of each example among all labelled rows
    a: float = 0.0
    b: float = 0.0

    def weights(self, terms: np.ndarray, count: np.ndarray) -> np.ndarray:
        """TF-IDF weights of unit length."""
        w = (1 + np.log(count)) * self.idf[terms]
        return w / max(float(np.sqrt(w @ w)), 1e-300)

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """vectors: (terms, weights) of each example, in index order."""
        size = [len(t) for t, _ in vectors]
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)  # of each example's vector
        self.term = np.concatenate([np.zeros(0, dtype=np.int64), *(t for t, _ in vectors)])
        self.value = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        who = np.repeat(np.arange(self.n), size)
        order = np.lexsort((who, self.term))
        term, self.who, self.weight = self.term[order], who[order], self.value[order]
        every = np.arange(len(self.idf) + 1)
        self.first = np.searchsorted(term, every)  # of each term's postings
        at = term * max(1, self.blocks) + self.who // BLOCK
        cut = np.flatnonzero(np.append([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
        self.most = np.maximum.reduceat(self.weight, cut) if len(cut) else np.zeros(0)
        self.block = at[cut] % max(1, self.blocks)
        self.first_block = np.searchsorted(at[cut] // max(1, self.blocks), every)  # of each term's largest weights
        self.top = np.zeros(len(self.idf))
        np.maximum.at(self.top, term, self.weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, best first, ties by index; `but` is passed over."""
        can = weights * self.top[terms]
        order = np.argsort(-can, kind="stable")
        order = order[can[order] > 0]
        terms, weights = terms[order], weights[order]
        size = self.first[terms + 1] - self.first[terms]
        left = np.append(np.cumsum(size[::-1])[::-1], 0)  # postings from each term on
        partial, done, wide = np.zeros(self.n), 0, float(len(self.term)) / max(1, self.n)
        while True:
            to = min(len(terms), max(8, 3 * done))
            at, length = _runs(self.first[terms[done:to]], self.first[terms[done:to] + 1])
            partial += np.bincount(self.who[at], weights=np.repeat(weights[done:to], length) * self.weight[at], minlength=self.n)
            done = to
            if but >= 0:
                partial[but] = 0
            if done == len(terms):
                able = np.flatnonzero(partial > 0)
                score = partial[able]
                break
            # the k-th best so far is a threshold; a block's largest weights bound what its examples can still gain
            least = float(np.partition(partial, self.n - k)[self.n - k]) if self.n >= k else 0.0
            at, length = _runs(self.first_block[terms[done:]], self.first_block[terms[done:] + 1])
            gain = np.bincount(self.block[at], weights=np.repeat(weights[done:], length) * self.most[at], minlength=self.blocks)
            able = partial + np.repeat(gain, BLOCK)[: self.n] >= least * (1 - 1e-12) if least else np.ones(self.n, dtype=bool)
            if np.count_nonzero(able) * wide < left[done]:  # fewer weights in the vectors of these than in the lists left
                able = np.flatnonzero(able)
                able = able[able != but]
                query = np.zeros(len(self.idf))
                query[terms] = weights
                at, length = _runs(self.start[able], self.start[able + 1])
                score = np.bincount(np.repeat(np.arange(len(able)), length), weights=query[self.term[at]] * self.value[at], minlength=len(able))
                able, score = able[score > 0], score[score > 0]
                break
        best = np.lexsort((able, -score))[:k] if len(able) <= 4 * k else self._best(able, score, k)
        return [(float(s), int(i)) for s, i in zip(score[best], able[best], strict=True)]

    @staticmethod
    def _best(able: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """The places of the k highest scores, ties by index."""
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((able[some], -score[some]))][:k]

    def vote(self, found: list[tuple[float, int]]) -> float:
        if not found:
            return 0.0
        score, who = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        w = self.share[who] / (np.maximum(0.0, 1 - score) + NEAREST_FLOOR)
        return float(w[self.label[who] == 1].sum() / w.sum())

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each text."""
        row, term, count = self.terms.counts(column)
        at = np.searchsorted(row, np.arange(len(column) + 1))
        return [(term[s:e], count[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]


def choose_terms(rows: DataFrame, n: tuple[int, int]) -> np.ndarray:
    """All terms that set the labels apart by a chi-square test, from examples (y, f) of which n[y] have label y.
    The driver gets the chosen terms only."""
    seen = rows.select("y", F.explode("f").alias("h")).groupBy("h").agg(F.count_if(F.col("y") == 0).cast("double").alias("a"), F.count_if(F.col("y") == 1).cast("double").alias("b"))
    no, yes = (F.lit(float(k)) for k in n)
    a, b, total, every = F.col("a"), F.col("b"), F.col("a") + F.col("b"), F.lit(float(sum(n)))
    chi = every * F.pow(b * (no - a) - a * (yes - b), F.lit(2.0)) / F.greatest(F.lit(1.0), total * (every - total) * no * yes)
    chosen = seen.filter((chi >= LEAST_CHI) & (total >= LEAST_SEEN)).select("h").collect()
    return np.sort(np.array([r["h"] for r in chosen], dtype=np.int64).view(np.uint64))


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[int, np.ndarray]:
    """(documents, documents with each term), over all of docs."""
    shared, size = docs.sparkSession.sparkContext.broadcast(terms), len(terms.hashes)

    def run(batches):
        seen, n = np.zeros(size, dtype=np.int64), 0
        for batch in slices(batches):
            _, term, _ = shared.value.counts(batch.column(0))
            seen += np.bincount(term, minlength=size)
            n += batch.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1], some), pa.int64()), pa.array(np.append([n], seen[some]), pa.int64())], ["term", "n"])

    out = np.zeros(size + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each chosen term
        out[r["term"] + 1] = r["n"]
    return int(out[0]), out[1:]


def examples(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int]) -> DataFrame:
    """(doc_id, y, weight, f: hashes of its terms, c: their counts) of the labelled sample, written."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            each = list(hashed(batch.column(1), heads=HEADS, pairs=False))
            h, row = (np.concatenate([e[k] for e in each]) for k in (0, 1))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.flatnonzero(np.append([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
            count, h, row = np.diff(np.append(first, len(h))), h[first], row[first]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            f, c = pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(count, pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), f, c], ["doc_id", "y", "weight", "f", "c"])

        return step

    sample = labelled_rows(docs, labels, label, rows).select("doc_id", "text", "y", F.col("weight").cast("double").alias("weight"))
    return written(map_batches(sample, make, "doc_id long, y int, weight double, f array<long>, c array<long>"), "examples")


def _held(rows: DataFrame, terms: Terms) -> list[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """(doc_id, y, weight, terms, counts) of the examples, by doc_id; only chosen terms reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(terms.hashes)

    def make():
        hashes = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            h, count = batch.column(3).flatten().to_numpy().view(np.uint64), batch.column(4).flatten().to_numpy()
            at = np.searchsorted(hashes, h)
            ok = hashes[np.minimum(at, len(hashes) - 1)] == h if len(hashes) else np.zeros(len(h), dtype=bool)
            ends = pa.array(np.concatenate([[0], np.cumsum(ok)])[ends], pa.int32())
            t, c = pa.ListArray.from_arrays(ends, pa.array(at[ok], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(count[ok], pa.int64()))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], t, c], ["doc_id", "y", "weight", "t", "c"])

        return step

    got = map_batches(rows, make, "doc_id long, y int, weight double, t array<long>, c array<long>").collect()
    out = [(r["doc_id"], r["y"], r["weight"], np.array(r["t"], dtype=np.int64), np.array(r["c"], dtype=np.int64)) for r in got]
    out = [(*r[:3], r[3][order], r[4][order]) for r in out for order in [np.argsort(r[3])]]
    return sorted(out, key=lambda r: r[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Index:
    docs = docs_of(docs)
    rows = examples(docs, labels, label, (clean_rows, toxic_rows))
    found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = (found.get(0, 0), found.get(1, 0))
    if not all(n):
        share = (n[1] + 1) / (sum(n) + 2)
        none = np.zeros(0)
        index = Index(Terms(np.zeros(0, dtype=np.uint64)), none, none, none, none, b=float(np.log(share / (1 - share))))
        index.fill([])
        return index
    terms = Terms(choose_terms(rows, n))
    total, seen = document_frequencies(docs, terms)
    index = Index(terms, np.log((total + 1) / (seen + 1)) + 1e-9, *(np.zeros(0),) * 3)
    every = _held(rows, terms)
    held = [(doc_id, y, weight, t, index.weights(t, c)) for doc_id, y, weight, t, c in every if len(t)]
    bare = [(y, weight) for _, y, weight, t, _ in every if not len(t)]
    held.sort(key=lambda e: (e[1], int(e[3][e[4].argmax()]), e[0]))  # alike examples share blocks
    index.ids, index.label, index.share = (np.array([e[k] for e in held]) for k in (0, 1, 2))
    index.fill([(e[3], e[4]) for e in held])
    votes = [index.vote(index.nearest(e[3], e[4], but=i)) for i, e in enumerate(held)]
    margin = np.array([*votes, *[0.0] * len(bare)])
    target = np.array([*(e[1] for e in held), *(r[0] for r in bare)])
    weight = np.array([*(e[2] for e in held), *(r[1] for r in bare)])
    index.a, index.b = calibration(margin, target, weight)
    return index


def scores(docs: DataFrame, index: Index, evidence: int = 5) -> DataFrame:
    """doc_id, score, evidence: array of (doc_id, cosine, label) of the nearest examples, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def make():
        held, cache = shared.value, {}

        def one(terms: np.ndarray, count: np.ndarray) -> tuple[float, list[dict]]:
            key = terms.tobytes() + count.tobytes()
            if key not in cache:
                if len(cache) > 20_000:
                    cache.clear()
                found = held.nearest(terms, held.weights(terms, count)) if len(terms) else []
                near = [{"doc_id": int(held.ids[i]), "cosine": s, "label": int(held.label[i])} for s, i in found[:evidence]]
                cache[key] = float(logistic(held.a * held.vote(found) + held.b)), near
            return cache[key]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [one(t, c) for t, c in held.vectors(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], kind)], ["doc_id", "score", "evidence"])

        return step

    return map_batches(docs_of(docs), make, "doc_id long, score double, evidence array<struct<doc_id long, cosine double, label int>>")


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; labels of the held-out fold are never read."""
    found = scores(docs, train(docs, labels.filter(fold(mod) != held_out)))
    return found.select("doc_id", (fold(mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")

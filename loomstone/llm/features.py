"""Hashed n-gram indicators of whole texts, as sorted (row, feature) pairs, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import textvec

MOST_BYTES = 256 << 10  # of a text that is learnt from


def _salt(kind: str, n: int = 1) -> np.uint64:
    return np.uint64((("word", "pair", "again", "head", "tail").index(kind) + 1) * (n + 1) * 0x9E3779B97F4A7C15 % 2**64)


def _edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], tail: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes, which words) of the first or last n bytes of the words longer than n, for each n of sizes."""
    if not sizes:
        return
    length = ends - starts
    which = np.flatnonzero(length > min(sizes))
    total = np.zeros(len(which), dtype=np.uint64)
    for k in range(max(sizes)):
        at = ends[which] - 1 - k if tail else starts[which] + k
        total += textvec.byte_hashes(data[at], k)
        if k + 1 in sizes:
            long = length[which] > k + 1
            which, total = which[long], total[long]
            yield k + 1, textvec.mix(total), which


def _runs(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that are one word n times, in one row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0], row[:0]
    changes = np.concatenate([[0], np.cumsum((hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))])
    same = changes[n - 1 :] == changes[:count]
    return hashes[:count][same], row[:count][same]


def hashed(column: pa.Array, heads: tuple[int, ...] = (), tails: tuple[int, ...] = (), pairs: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hash, row) of every n-gram, kind by kind: words, pairs of words, n-grams of one word over and
    over (whatever the word), and the first or last bytes of words."""
    data, offsets = textvec.column_bytes(column)
    starts, ends, row = textvec.words(data, offsets)
    hashes = textvec.span_hashes(data, starts, ends)
    yield textvec.mix(hashes + _salt("word")), row
    if pairs:
        two, two_row = textvec.grams(hashes, row, 2)
        yield textvec.mix(two + _salt("pair")), two_row
        for n in (2, 3, 4, 8, 16):
            run, run_row = _runs(hashes, row, n)
            yield textvec.mix(np.zeros(len(run), dtype=np.uint64) + _salt("again", n)), run_row
    for sizes, tail in ((heads, False), (tails, True)):
        for n, h, which in _edges(data, starts, ends, sizes, tail):
            yield textvec.mix(h + _salt("tail" if tail else "head", n)), row[which]


def ngrams(column: pa.Array, bits: int, wanted: np.ndarray | None = None, **kinds) -> np.ndarray:
    """row << bits | feature of every n-gram of hashed(), in no order; features are the first bits of the
    hashes. wanted: a mask of features."""
    found = []
    for values, rows in hashed(column, **kinds):
        feature = values >> np.uint64(64 - bits)
        if wanted is not None:
            ok = wanted[feature.astype(np.int64)]
            feature, rows = feature[ok], rows[ok]
        found.append(rows.astype(np.uint64) << np.uint64(bits) | feature)
    return np.concatenate(found)


def indicators(column: pa.Array, bits: int, **kinds) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each once, ascending."""
    key = np.unique(ngrams(column, bits, **kinds))
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64(2**bits - 1)).astype(np.int64)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibration(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of Platt's logistic(a * margin + b), by Newton steps on smoothed targets."""
    pos, neg = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = logistic(a * margin + b)
        grad = x @ (weight * (p - target)) + 1e-6 * np.array([a, 0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, y, weight): at most most[y] rows of each class y, by hash order of doc_id, and of these
    the ones whose text has at most most_bytes bytes.

    weight restores the classes' shares among all labelled rows. Null labels and labels without a
    document are left out; a doc_id labelled several times counts once, with its largest label, and a
    doc_id with several rows once, with the text of the least hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (0, 1)]
    weight = [shares.get(y, 0) / max(1, min(most[y], shares.get(y, 0))) for y in (0, 1)]
    # at most sum(most) ids, whatever the size of the corpus
    picked = F.broadcast(picks[0].unionByName(picks[1]))
    rows = docs.filter(F.octet_length("text") <= most_bytes).join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return rows.select("doc_id", "text", "y", F.when(F.col("y") == 1, weight[1]).otherwise(weight[0]).alias("weight"))

"""Packing by cutting-stock column generation.

A document's ids (and an end id) are cut into full sequences and one remainder. Full pieces fill a
sequence each. The remainders' length histogram, in classes of `step` ids, is a cutting-stock problem
of bounded size whatever the corpus: a linear program over patterns of classes, and over cuts of a class
into two, is solved by column generation (revised simplex; a knapsack dynamic program prices patterns),
its solution is rounded down and what is left is packed first-fit decreasing. Documents are ranked
within their class, in the order in which they are read, and take the cuts and pattern places of that
class in turn. Only the histogram (at most length / step + 1 rows) and the plan reach the driver.

Null and empty texts are one end id; a null doc_id stays null and its row is packed like any other.
Documents of any length are read whole. Ties in a class go by read order; repeated rows are packed like
others, each row by itself. An empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import docs_of, slices, written

LENGTH, STEP, END_ID = 2048, 8, 1
MOST_STARTS = 2_000_000  # 16 MB of ranks


class ByteTokenizer:
    """ids of a byte-level BPE file as the tokenizers library gives them.

    Texts of Latin characters without added tokens or very long words take a faster encoder built from
    the same vocabulary; all others take the library itself.
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed by the tokenizer
        self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = [t for t in added]
        self.odd = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]|\S{400}|\s{400}").search

    def __call__(self, text: str) -> list[int]:
        if self.odd(text) or any(t in text for t in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast(text)


@functools.lru_cache(maxsize=2)
def _tokenizer(file: str) -> ByteTokenizer:
    """One for each worker process."""
    return ByteTokenizer(file)


@dataclass
class Plan:
    """What becomes of the items of each class (class c holds sizes of c + 1 steps), by rank.

    Entries of a class follow each other by rank. An entry either cuts its items, or gives them places in
    the instances of a pattern. Pieces of cut items take the next free ranks of their own classes.
    """

    entries: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)  # first rank, cut at or 0, each, base, slot
    ranks: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # items of each class so far
    used: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # of which spoken for
    sequences: int = 0

    def cut(self, cls: int, at: int, n: int) -> None:
        """Cuts the next n items of a class after `at` steps."""
        one, two = at - 1, cls - at
        first = int(self.ranks[one])
        self.ranks[one] += n
        second = int(self.ranks[two])
        self.ranks[two] += n
        self.entries.setdefault(cls, []).append((int(self.used[cls]), at, 0, first, second))
        self.used[cls] += n

    def fill(self, pattern: np.ndarray, n: int) -> None:
        """Gives the next items n sequences of a pattern."""
        slot = 0
        for c in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[c])
            self.entries.setdefault(c, []).append((int(self.used[c]), 0, each, self.sequences, slot))
            self.used[c] += each * n
            slot += each
        self.sequences += n

    def left(self) -> np.ndarray:
        return self.ranks - self.used

    def places(self, cls: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
        """The pieces of items: item (index), skip (steps before it), steps or 0 for the rest, sequence, slot."""
        item, skip, steps = np.arange(len(cls)), np.zeros(len(cls), dtype=np.int64), np.zeros(len(cls), dtype=np.int64)
        done: list[tuple[np.ndarray, ...]] = [(item[:0],) * 5]
        while len(item):
            more: list[tuple[np.ndarray, ...]] = []
            for c in np.unique(cls).tolist():
                mine = np.flatnonzero(cls == c)
                table = np.array(self.entries[c], dtype=np.int64)
                e = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                inside, whole = rank[mine] - e[:, 0], e[:, 1] == 0
                k, w, i = mine[whole], e[whole], inside[whole]
                done.append((item[k], skip[k], steps[k], w[:, 3] + i // w[:, 2], w[:, 4] + i % w[:, 2]))
                k, w, i = mine[~whole], e[~whole], inside[~whole]
                more.append((item[k], skip[k], w[:, 1], w[:, 1] - 1, w[:, 3] + i))
                more.append((item[k], skip[k] + w[:, 1], np.where(steps[k] > 0, steps[k] - w[:, 1], 0), c - w[:, 1], w[:, 4] + i))
            item, skip, steps, cls, rank = (np.concatenate(x) for x in zip(*more, strict=True))
        return dict(zip(("item", "skip", "steps", "sequence", "slot"), (np.concatenate(x) for x in zip(*done, strict=True)), strict=True))


def knapsack(price: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """The best total price of items (item i has size i + 1, any number of each) within cap, and their counts."""
    best, take = np.zeros(cap + 1), np.full(cap + 1, -1)
    for c in range(1, cap + 1):
        value = price[: min(c, len(price))] + best[c - 1 :: -1][: min(c, len(price))]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], take[c] = value[k], k
        else:
            best[c], take[c] = best[c - 1], -1
    counts = np.zeros(len(price), dtype=np.int64)
    c = cap
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(take[c]) + 1
    return float(best[cap]), counts


def best_cuts(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each size, the cheapest two sizes that make it up: (their price, the first of them)."""
    m = len(price)
    best, at = np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    for a in range(1, m // 2 + 1):
        value = price[a - 1] + price[: m - a]  # of sizes a + 1 to m
        better = value < best[a:]
        best[a:] = np.where(better, value, best[a:])
        at[a:] = np.where(better, a, at[a:])
    return best, at


def column_generation(demand: np.ndarray, cap: int, cut_cost: float = 0.004, gap: float = 1e-4, most: int = 2500) -> tuple[list[tuple[np.ndarray, float]], list[tuple[int, int, float]]]:
    """A linear program that places demand[i] items of size i + 1 in few bins of cap.

    Columns are patterns (one bin) and cuts of a size into two (`cut_cost` bins, so that documents are
    cut only where it saves room). A knapsack prices patterns; cuts are priced by the duals. Stops at the
    optimum, within `gap` of it, or after `most` columns; all iterates are feasible.
    Gives patterns (counts, times) and cuts (size, first part, times).
    """
    m = len(demand)
    if not demand.any():
        return [], []
    # a trace of demand everywhere keeps pivots from stalling
    x = demand + np.random.Generator(np.random.PCG64(1)).random(m) * 1e-6 * demand.sum() / m
    d, fit = x.copy(), cap // np.arange(1, m + 1)
    kinds: list[tuple] = [(np.eye(1, m, k, dtype=np.int64)[0] * fit[k], 0, 0) for k in range(m)]
    inverse, cost = np.diag(1 / fit), np.ones(m)
    x = x / fit
    for _ in range(most):
        dual = cost @ inverse
        apart, at = best_cuts(dual)
        gain = dual - apart - cut_cost
        s = int(gain.argmax())
        value, counts = knapsack(dual, cap)
        if gain[s] <= cut_cost * 1e-2 and (value <= 1 + 1e-9 or cost @ x <= (dual @ d) / value * (1 + gap)):
            break
        if gain[s] > (value - 1) / 2:
            column, price = np.zeros(m), cut_cost
            column[s] = 1
            column[at[s] - 1] -= 1
            column[s - at[s]] -= 1
            kind = (None, s + 1, int(at[s]))
        else:
            column, price, kind = counts.astype(float), 1.0, (counts, 0, 0)
        move = inverse @ column
        ok = move > 1e-9
        ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
        out = int(ratio.argmin())
        step = max(float(ratio[out]), 0.0)
        x = np.maximum(x - step * move, 0)
        x[out], kinds[out], cost[out] = step, kind, price
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    patterns = [(k[0], float(t)) for k, t in zip(kinds, x, strict=True) if k[0] is not None]
    return patterns, [(k[1], k[2], float(t)) for k, t in zip(kinds, x, strict=True) if k[0] is None]


def cutting_plan(demand: np.ndarray, cap: int) -> Plan:
    """Whole numbers for all items: cuts and patterns rounded down, the rest first-fit decreasing, where
    the last item of a sequence is cut to fit it."""
    plan = Plan(ranks=demand.astype(np.int64).copy(), used=np.zeros(len(demand), dtype=np.int64))
    patterns, cuts = column_generation(demand, cap)
    for size, at, times in sorted(cuts, key=lambda c: (-c[0], c[1])):  # larger first: their parts may be cut again
        n = min(int(times + 1e-3), int(plan.left()[size - 1]))
        if n > 0:
            plan.cut(size - 1, at, n)
    for pattern, times in sorted(patterns, key=lambda p: -p[1]):
        some = pattern > 0
        n = min([int(times + 1e-3), *(plan.left()[some] // pattern[some])])
        if n > 0:
            plan.fill(pattern, int(n))
    while (left := plan.left()).any():
        pattern, room = np.zeros_like(left), cap
        for c in np.flatnonzero(left)[::-1].tolist():
            n = min(int(left[c]), room // (c + 1))
            pattern[c] = n
            room -= n * (c + 1)
        larger = np.flatnonzero(left - pattern)
        larger = larger[larger + 1 > room]
        if room and len(larger):
            plan.cut(int(larger[0]), room, 1)
            pattern[room - 1] += 1
            plan.fill(pattern, 1)
        else:
            plan.fill(pattern, int((left[pattern > 0] // pattern[pattern > 0]).min()))
    return plan


def cut_documents(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, step: int = STEP, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per full piece and remainder: doc_id, start, length, ids_crc32, doc_tokens, its read
    partition, class and rank there, and the ids (of remainders, which may be cut again; of all with_ids)."""
    full = -(-length // step)

    def run(batches):
        encode, seen = _tokenizer(tokenizer_file), {}
        part = TaskContext.get().partitionId()
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "cls", "rank", "ids"]
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    cls = full if len(piece) == length else (len(piece) - 1) // step
                    rank = seen[cls] = seen.get(cls, -1) + 1
                    out.append((doc_id, start, len(piece), zlib.crc32(piece), len(ids), part, cls, rank, piece.tobytes() if with_ids or cls != full else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, cls int, rank long, ids binary"
    return docs_of(docs).mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer_file: str, length: int = LENGTH, step: int = STEP, end_id: int = END_ID, with_ids: bool = False, most_starts: int = MOST_STARTS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    The first rank of each read partition and class is sent to the executors where there are at most
    `most_starts` of them, and joined beyond.
    """
    full = -(-length // step)
    pieces = written(cut_documents(docs, tokenizer_file, length, step, end_id, with_ids), "pieces")
    counts = written(pieces.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(full + 1, dtype=np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # at most length / step + 1 rows
        histogram[r["cls"]] = r["n"]
    plan = cutting_plan(histogram[:full], full)
    first = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "cls", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    table = None
    if counts.count() <= most_starts:  # of checked size: the pieces are placed where they are read
        parts = starts.toPandas().pivot(index="part", columns="cls", values="before").reindex(columns=range(full + 1)).fillna(0)
        table = docs.sparkSession.sparkContext.broadcast((parts.index.to_numpy(dtype=np.int64), parts.to_numpy(dtype=np.int64)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot", "ids"]

    def ranks(b: pa.RecordBatch) -> np.ndarray:
        if table is None:
            return b.column("rank").to_numpy() + b.column("before").to_numpy()
        part, before = table.value
        return b.column("rank").to_numpy() + before[np.searchsorted(part, b.column("part").to_numpy()), b.column("cls").to_numpy()]

    def place_full(batches):
        for b in slices(batches):
            sequence = plan.sequences + ranks(b)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:5]), pa.array(sequence), pa.array(np.zeros(len(sequence), dtype=np.int64)), b.column("ids")], names)

    def place(batches):
        for b in slices(batches):
            got = plan.places(b.column("cls").to_numpy(), ranks(b))
            item, skip = got["item"], got["skip"] * step
            old = b.column("length").to_numpy()
            size = np.where(got["steps"] > 0, got["steps"] * step, old[item] - skip)
            crc, raw = b.column("ids_crc32").to_numpy()[item].copy(), b.column("ids").to_pylist()
            ids: list[bytes | None] = [raw[i] if with_ids else None for i in item.tolist()]
            for p in np.flatnonzero(size != old[item]).tolist():
                some = raw[item[p]][4 * skip[p] : 4 * (skip[p] + size[p])]
                crc[p] = zlib.crc32(some)
                ids[p] = some if with_ids else None
            start = b.column("start").to_numpy()[item] + skip
            columns = [b.column("doc_id").take(pa.array(item)), pa.array(start), pa.array(size), pa.array(crc), b.column("doc_tokens").take(pa.array(item)), pa.array(got["sequence"]), pa.array(got["slot"]), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long, ids binary"

    def ranked(some: DataFrame) -> DataFrame:
        return some if table is not None else some.join(starts, ["part", "cls"])

    left = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    alone = ranked(pieces.filter(F.col("cls") == full)).mapInArrow(place_full, kind).withColumn("offset", F.lit(0).cast("long")).select(*columns)
    shared = ranked(pieces.filter(F.col("cls") != full)).mapInArrow(place, kind)
    shared = (shared if with_ids else shared.drop("ids")).withColumn("offset", F.coalesce(F.sum("length").over(left), F.lit(0)))
    return alone.unionByName(shared.select(*columns))

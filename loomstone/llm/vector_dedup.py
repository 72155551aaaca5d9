"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector, less the mean of its label, the concatenation of random hyperplane bits, orders the vectors of a label
lexicographically by it and compares each vector with the `window` before it, in double precision.
Verified pairs of all passes are united. How many passes a label needs follows from its size and its
mean cosine: two vectors at the threshold, less the mean, agree in the bits that tell windows apart with
a known probability, and passes go on until `recall` of such pairs are met; no label has fewer than the
largest one without a common direction. Pairs more alike are met more often. A label with so strong a
common direction that its passes would compare as much as all its pairs has all its pairs compared. That
a label's vectors have no other order than a common direction is assumed, not measured.

Equal vectors of a label are one class, so copies cost no windows. Range partitions split long runs of
one hash; each partition hands its last `window` vectors to the next ones, over as many as the window spans. Links inside a component are then
counted exactly, in pairs of blocks of bounded size, without emitting pairs. Only a link between
vectors that no chain of met pairs joins can be missed; tests measure the recall against brute force.

Null labels and vectors that are null, empty, zero, or hold null or non-finite components link with
nothing. Ties: the smallest vec_id names a class and a component. Rows with a null vec_id are left out;
repeated rows count as copies of each other. Vectors of different length never link. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import map_batches, written
from loomstone.llm.components import components

BITS, BLOCK, LEAST_BLOCK, SPLIT = 63, 1024, 64, 24


def passes_needed(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes until a pair at the threshold meets with probability `recall`, among n vectors of a label."""
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** max(1.0, math.log2(max(n, 2) / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 4


def planes(dim: int, number: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([20240301, dim, number])).standard_normal((dim, BITS))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with the same row of y (unit vectors): what decides every link."""
    return np.einsum("ij,ij->i", x, y)


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y link, as a matrix. A product is rounded otherwise than cosines(), so what
    lies close to the threshold is decided by that."""
    about = x @ y.T
    hit = about >= threshold
    i, j = np.nonzero(np.abs(about - threshold) < 1e-9)
    hit[i, j] = cosines(x[i], y[j]) >= threshold
    return hit


def _vectors(df: DataFrame) -> DataFrame:
    """vec_id, label, dim, vec (unit length, float64 bytes), key (of label and vector); vec null where invalid."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels = batch.column(1).to_pylist()
            vecs, keys, dims = [], [], []
            column = batch.column(2)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = [0 if s is None else s for s in column.value_lengths().to_pylist()]
            ends = np.cumsum([0, *sizes])
            for i, label in enumerate(labels):
                v = flat[ends[i] : ends[i + 1]] + 0.0
                norm = np.linalg.norm(v) if len(v) and np.isfinite(v).all() else 0.0
                scale = np.abs(v).max() if norm and not np.isfinite(norm) else 1.0
                if label is None or not norm:
                    vecs.append(None)
                    keys.append(None)
                    dims.append(0)
                    continue
                v = v / scale
                keys.append(hashlib.blake2b(repr((label, len(v))).encode() + v.astype("<f8").tobytes(), digest_size=16).digest())
                vecs.append((v / np.linalg.norm(v)).astype("<f8").tobytes())
                dims.append(len(v))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "dim", "vec", "key"])

        return step

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(rows.filter("vec_id IS NOT NULL"), make, "vec_id long, label string, dim int, vec binary, key binary")


def _directions(classes: DataFrame, base: int, threshold: float, window: int, recall: float) -> DataFrame:
    """(label, dim, mean, size, passes, exact) of the labels larger than a window."""

    def add(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for label, dim, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault((label, dim), [0, np.zeros(dim)])
                held[0] += 1
                held[1] += np.frombuffer(raw, dtype="<f8")
            columns = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([h[0] for h in sums.values()], pa.int64()), pa.array([h[1].tobytes() for h in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "dim", "n", "total"])

    def settle(table: pa.Table) -> pa.Table:
        n = sum(table.column("n").to_pylist())
        if n <= window:
            return kind.empty_table()
        # rounded, so that the order of the sums does not show
        mean = np.round(np.sum([np.frombuffer(b, dtype="<f8") for b in table.column("total").to_pylist()], axis=0) / n, 9)
        common = max(0.0, float(n * (mean @ mean) - 1) / (n - 1))  # the mean cosine of two of the label
        left = max(0.0, (threshold - common) / (1 - common)) if common < threshold else 0.0
        passes = max(base, passes_needed(n, left, window, recall))
        row = {"label": table.column("label")[0].as_py(), "dim": table.column("dim")[0].as_py(), "mean": mean.tobytes(), "size": n, "passes": passes, "exact": passes > base and 2 * window * passes >= n}
        return pa.Table.from_pylist([row], schema=kind)

    kind = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("mean", pa.binary()), ("size", pa.int64()), ("passes", pa.int32()), ("exact", pa.bool_())])
    sums = classes.select("label", "dim", "vec").mapInArrow(add, "label string, dim int, n long, total binary")
    return sums.groupBy("label", "dim").applyInArrow(settle, "label string, dim int, mean binary, size long, passes int, exact boolean")


def _spread(classes: DataFrame, base: int) -> DataFrame:
    """A row for each vector and pass of its label, with its hash: (pass, label, dim, hash, rep, vec)."""

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            raw, means = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            passes = np.array([base if p is None else p for p in batch.column(5).to_pylist()])
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(raw[i] for i in mine), dtype="<f8").reshape(len(mine), dim)
                x = x - np.frombuffer(b"".join(bytes(8 * dim) if means[i] is None else means[i] for i in mine), dtype="<f8").reshape(len(mine), dim)
                for p in range(int(passes[mine].max())):
                    on = passes[mine] > p
                    some = batch.take(pa.array(mine[on]))
                    bits = (x[on] @ planes(dim, p) > 0).astype(np.uint64)
                    code = (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(code), p, dtype=np.int32)), some.column(1), some.column(2), pa.array(code), some.column(0), some.column(3)],
                        ["pass", "label", "dim", "hash", "rep", "vec"],
                    )

    return classes.select("rep", "label", "dim", "vec", "mean", "passes").mapInArrow(run, "pass int, label string, dim int, hash long, rep long, vec binary")


def _blocks(size: Column) -> Column:
    """Into how many blocks a group of so many vectors falls: SPLIT of them, of LEAST_BLOCK to BLOCK vectors,
    so that a middling group is many small tasks, and no block is larger than BLOCK."""
    return F.greatest(F.ceil(size / BLOCK), F.least(F.lit(SPLIT), F.ceil(size / LEAST_BLOCK))).cast("int")


def _all_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that join all near pairs of a label, from (label, dim, size, rep, vec), in pairs of blocks."""
    dealt = classes.withColumn("blocks", _blocks(F.col("size")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "vec")

    def run(table: pa.Table) -> pa.Table:
        own, rep, raw = table.column("own").to_numpy(), table.column("rep").to_numpy(), table.column("vec").to_pylist()
        x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
        left, right = np.flatnonzero(own == table.column("a")[0].as_py()), np.flatnonzero(own == table.column("b")[0].as_py())
        u, v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for k in range(0, len(left), BLOCK):
            some = left[k : k + BLOCK]
            i, j = np.nonzero(near(x[some], x[right], threshold))
            i, j = rep[some[i]], rep[right[j]]
            u, v = _forest(np.concatenate([u, i[i != j]]), np.concatenate([v, j[i != j]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.repartition("label", "dim", "a", "b").groupBy("label", "dim", "a", "b").applyInArrow(run, "u long, v long")


def _near(group: np.ndarray, rep: np.ndarray, raw: list[bytes], dims: np.ndarray, window: int, threshold: float, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join rows at most `window` apart in one group, the later of them from `fresh` on."""
    us, vs = [], []
    for dim in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == dim)
        x = np.frombuffer(b"".join(raw[i] for i in mine), dtype="<f8").reshape(len(mine), dim)
        for k in range(1, min(window, len(mine) - 1) + 1):
            same = np.flatnonzero((group[mine[k:]] == group[mine[:-k]]) & (mine[k:] >= fresh))
            if len(same):
                hit = same[cosines(x[same + k], x[same]) >= threshold]
                us.append(rep[mine[hit + k]])
                vs.append(rep[mine[hit]])
    none = np.zeros(0, dtype=np.int64)
    return _forest(np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least of its component: as many as nodes at most, however many pairs."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    name = np.arange(len(nodes))
    while True:
        least = name.copy()
        np.minimum.at(least, a, name[b])
        np.minimum.at(least, b, name[a])
        least = least[least]
        if np.array_equal(least, name):
            other = name != np.arange(len(nodes))
            return nodes[other], nodes[name[other]]
        name = least


def _group_ids(p, label, dim) -> np.ndarray:
    """Numbers that are equal exactly for equal (pass, label, dim), within one call."""
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault(k, len(seen)) for k in zip(p, label, dim, strict=True)], dtype=np.int64)


_EDGE = "pass int, label string, dim int, hash long, rep long, vec binary"


def _windows(ordered: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links (u, v), and the first and last `window` rows of each partition: (u, v, side, part, size, rows...),
    side 0 for the last rows and 1 for the first; size is that of the partition."""

    def run(batches):
        part, kept, first, size = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size += batch.num_rows
            whole = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            fresh = whole.num_rows - batch.num_rows
            lists = [whole.column(k).to_pylist() for k in (0, 1, 2)]
            u, v = _near(_group_ids(*lists), whole.column(4).to_numpy(), whole.column(5).to_pylist(), whole.column(2).to_numpy(), window, threshold, fresh)
            yield links(u, v)
            if first is None or first.num_rows < window:
                more = whole if first is None else pa.Table.from_batches([first, batch]).combine_chunks().to_batches()[0]
                first = more.slice(0, window)
            kept = whole.slice(max(0, whole.num_rows - window))
        if kept is not None:
            yield edge(kept, 0, part, size)
            yield edge(first, 1, part, size)

    names = ["u", "v", "side", "part", "size", "pass", "label", "dim", "hash", "rep", "vec"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def links(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *(pa.nulls(len(u), k) for k in kinds[2:])], names)

    def edge(rows, side, part, size):
        n = rows.num_rows
        own = [c.cast(k) for c, k in zip(rows.columns, kinds[5:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([side] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([size] * n, pa.int64()), *own], names)

    return ordered.mapInArrow(run, "u long, v long, side int, part int, size long, " + _EDGE)


def meeting_places(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """(part, later part) for which the last `window` rows of a partition reach into a later one, from the
    (part, rows) of all partitions that have rows. Windows go over as many small partitions as they must."""
    found, ordered = [], sorted(sizes)
    for k, (part, _) in enumerate(ordered):
        between = 0
        for later, rows in ordered[k + 1 :]:
            if between >= window:
                break
            found.append((part, later))
            between += rows
    return found


def _across(edges: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links between the last rows of partitions and the first of a later one, at most `window` rows apart:
    at most 2 * window rows are compared in a group."""
    spark = edges.sparkSession
    sizes = [(r["part"], r["size"]) for r in edges.groupBy("part").agg(F.max("size").alias("size")).collect()]  # a row for each shuffle partition
    places = spark.createDataFrame(meeting_places(sizes, window), "part int, at int")
    last = edges.filter("side = 0").join(places, "part").select("at", "side", "part", "pass", "label", "dim", "hash", "rep", "vec")
    first = edges.filter("side = 1").select(F.col("part").alias("at"), "side", "part", "pass", "label", "dim", "hash", "rep", "vec")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("side", "part", "pass", "label", "dim", "hash", "rep")])
        before = table.column("side").to_pylist().count(0)
        table = table.slice(max(0, before - window))
        fresh = min(before, window)
        lists = [table.column(c).to_pylist() for c in ("pass", "label", "dim")]
        u, v = _near(_group_ids(*lists), table.column("rep").to_numpy(), table.column("vec").to_pylist(), table.column("dim").to_numpy(), window, threshold, fresh)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return last.unionByName(first).groupBy("at").applyInArrow(run, "u long, v long")


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, n): vectors linked directly with each, from (component, rep, copies, vec), in pairs of blocks."""
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    dealt = members.join(sizes, "component").withColumn("blocks", _blocks(F.col("_size")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "copies", "vec")

    def run(table: pa.Table) -> pa.Table:
        own, copies = table.column("own").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        raw = table.column("vec").to_pylist()
        x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        n = np.zeros(len(raw))
        for k in range(0, len(left), BLOCK):
            some = left[k : k + BLOCK]
            hit = near(x[some], x[right], threshold)
            if a == b:
                hit |= some[:, None] == right[None, :]
                n[some] += hit @ copies[right] - 1
            else:
                n[some] += hit @ copies[right]
                n[right] += hit.T @ copies[some]
        return pa.table({"rep": table.column("rep"), "n": pa.array(np.rint(n).astype(np.int64))})

    # dealt by all keys: a join by component would leave the blocks of a component in one task
    return dealt.repartition("component", "a", "b").groupBy("component", "a", "b").applyInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_vectors(df: DataFrame, threshold: float = 0.93, window: int = 24, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector of df (vec_id, embedding, label)."""
    rows = written(_vectors(df), "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec")
    )
    classes = written(classes, "classes")
    most = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    base = passes_needed(most, threshold, window, recall)
    directions = written(_directions(classes, base, threshold, window, recall), "directions")
    placed = classes.join(directions, ["label", "dim"], "left")
    spread = _spread(placed.filter("exact IS NULL OR NOT exact"), base)
    order = ["pass", "label", "dim", "hash", "rep"]
    met = written(_windows(spread.repartitionByRange(*order).sortWithinPartitions(*order), window, threshold), "met")
    links = met.filter("side IS NULL").select("u", "v").unionByName(_across(met.filter("side IS NOT NULL"), window, threshold))
    links = links.unionByName(_all_pairs(placed.filter("exact"), threshold))
    found = written(components(links), "components").withColumnRenamed("node", "rep")
    linked = written(classes.join(found, "rep").select("component", "rep", "copies", "vec"), "linked")
    counts = classes.select("key", "rep", "copies").join(found, "rep", "left").join(_count_links(linked, threshold), "rep", "left")
    counts = counts.select("key", F.coalesce("n", F.col("copies") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    out = rows.select("vec_id", "key").join(counts, "key", "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN least ON least.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

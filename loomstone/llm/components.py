"""Connected components by alternating large-star and small-star rounds on written tables.

At most ONE_TASK links are settled by one task instead: rounds over few links cost the driver thousands of
tasks and tens of plans, whatever the links are. More links go through rounds.

Each round is two aggregations with partial minima and two joins. The first, in which a node may have a
third of all links, is between written tables, so adaptive execution can split it; in the second a node
meets the few names that came to it. Rounds grow with the
logarithm of a component's diameter. Nothing is collected but the size and a checksum of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import written

ONE_TASK = 1 << 18  # links, in 4 MB


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the least node of its component) of every node of the links (u, v), ascending."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, name = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = name[a], name[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[name]
        np.minimum.at(name, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (name[name] != name).any():
            name = name[name]


def _settled(edges: DataFrame) -> DataFrame:
    """Links (u, v) from each node to the least of its component, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in batch.columns] for batch in batches]
        node, least = least_nodes(*(np.concatenate([g[k] for g in got]) for k in (0, 1))) if got else (np.zeros(0, dtype=np.int64),) * 2
        far = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(least[far])], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "u long, v long")


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _linked(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).drop("_u")


def _named(stars: DataFrame) -> DataFrame:
    ends = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (u, v), u <> v, any order.

    Self-links and nulls are ignored; repeated and reversed links count once; no edges, no rows.
    """
    at = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    at = written(at, "edges")
    mark = _mark(at)
    if 0 < mark[0] <= one_task:
        return _named(written(_settled(at), "edges"))
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a node with many links can be split in the join: adaptive execution does not look under an aggregation
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = _linked(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _linked(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        at = written(small, "edges")
        last, mark = mark, _mark(at)
        if last == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _named(at)

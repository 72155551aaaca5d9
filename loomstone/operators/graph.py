"""Labelled graphs as edge tables (edge_id, src, label, dst, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import mvcc
from loomstone.sources.shared import checkpointed as _keep


def outgoing(edges: DataFrame, vertex, label=None) -> DataFrame:
    out = edges.filter(F.col("src") == vertex)
    return out if label is None else out.filter(F.col("label") == label)


def incoming(edges: DataFrame, vertex, label=None) -> DataFrame:
    out = edges.filter(F.col("dst") == vertex)
    return out if label is None else out.filter(F.col("label") == label)


def neighbours(edges: DataFrame, vertex) -> DataFrame:
    """Targets of outgoing edges; parallel edges repeat them."""
    return outgoing(edges, vertex).select("dst")


def has_edge(edges: DataFrame, pairs: DataFrame, by_label: bool = False) -> DataFrame:
    """pairs (src, dst[, label]) with whether an edge exists."""
    on = ["src", "dst", *(["label"] if by_label else [])]
    have = edges.select(*on).distinct().withColumn("found", F.lit(True))
    return pairs.join(have, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways; the reverse copy has no weight."""
    back = edges.select("edge_id", F.col("dst").alias("src"), "label", F.col("src").alias("dst"), F.lit(None).cast(edges.schema["weight"].dataType).alias("weight"))
    return edges.select(*back.columns).unionByName(back)


def latest(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge for each (src, label, edge_id): the one written last, whatever its target."""
    key = ["src", "label", "edge_id"]
    rest = [c for c in edges.columns if c not in key]
    best = edges.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_v"))
    return best.select(*key, *(F.col("_v")[c].alias(c) for c in rest if c != seq))


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "label", "edge_id"), ["src", "label", "edge_id"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree): one aggregation over both ends."""
    ends = edges.select(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("vertex").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def labels(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


def stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(vertices(edges).agg(F.count(F.lit(1)).alias("vertices")))


def bfs(edges: DataFrame, start, most: int | None = None, label=None) -> DataFrame:
    """(vertex, depth) of all reached from start by outgoing edges, each once, cycles or not.

    A round joins the frontier with the edges and drops what was visited; only the count of the frontier
    comes to the driver. The number of rounds is the depth of what is reached, or `most`.
    """
    spark: SparkSession = edges.sparkSession
    steps = (edges if label is None else edges.filter(F.col("label") == label)).select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    seen = spark.createDataFrame([(start, 0)], "vertex string, depth int").withColumn("vertex", F.col("vertex").cast(kind)) if kind.simpleString() == "string" else spark.createDataFrame([(start, 0)], f"vertex {kind.simpleString()}, depth int")
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        nxt = steps.join(frontier, steps["src"] == frontier["vertex"]).select(F.col("dst").alias("vertex")).distinct()
        frontier = _keep(nxt.join(seen, "vertex", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = _keep(seen.unionByName(frontier))
    return seen


def reachable(edges: DataFrame, start, **how) -> DataFrame:
    return bfs(edges, start, **how).select("vertex")


def _grown(edges: DataFrame, names: DataFrame, rounds: int) -> DataFrame:
    """(vertex, name) after every vertex has taken the least name that reaches it along edges."""
    for _ in range(rounds):
        came = edges.join(names, edges["src"] == names["vertex"]).select(F.col("dst").alias("vertex"), "name")
        more = _keep(names.unionByName(came).groupBy("vertex").agg(F.min("name").alias("name")))
        changed = more.join(names, ["vertex", "name"], "left_anti").isEmpty()
        names = more
        if changed:
            return names
    raise RuntimeError(f"names did not settle in {rounds} rounds")


def on_cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(vertex) of all that reach themselves, as for the deadlocks of a wait-for graph; null ends are ignored.

    Vertices without incoming or outgoing edges are peeled off until none is left. Then strongly connected
    components are taken off: the least name spreads forward; inside one name, what reaches the vertex of that
    name is its component. No pairs of vertices are made. Raises when `rounds` run out.
    """
    left = _keep(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    found = left.filter("src = dst").select(F.col("src").alias("vertex"))
    left = _keep(left.filter("src <> dst"))
    for _ in range(rounds):
        for _ in range(rounds):
            n = left.count()
            has_in, has_out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = _keep(left.join(has_in, "src", "left_semi").join(has_out, "dst", "left_semi"))
            if left.count() == n:
                break
        else:
            raise RuntimeError(f"vertices without a way on were not all found in {rounds} rounds")
        if not n:
            return found.distinct()
        own = vertices(left).select("vertex", F.col("vertex").alias("name"))
        names = _grown(left, own, rounds)
        one, two = names.select(F.col("vertex").alias("src"), F.col("name").alias("a")), names.select(F.col("vertex").alias("dst"), F.col("name").alias("b"))
        inside = _keep(left.join(one, "src").join(two, "dst").filter("a = b").select("src", "dst"))
        # backwards from each name's own vertex, along edges inside the name
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        heads = names.filter("vertex = name")
        reach = heads
        for _ in range(rounds):
            came = back.join(reach, back["src"] == reach["vertex"]).select(F.col("dst").alias("vertex"), "name")
            more = _keep(reach.unionByName(came).distinct())
            done = more.count() == reach.count()
            reach = more
            if done:
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        large = reach.groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("name")
        found = _keep(found.unionByName(reach.join(large, "name", "left_semi").select("vertex")))
        gone = reach.select("vertex")
        left = _keep(inside.join(gone, inside["src"] == gone["vertex"], "left_anti").join(gone, inside["dst"] == gone["vertex"], "left_anti"))
    raise RuntimeError(f"components were not all found in {rounds} rounds")


def preorder(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(vertex, path, depth) in depth-first order on an acyclic graph, children by name, to a depth."""
    return edges.sparkSession.sql(
        """
        WITH RECURSIVE walk(vertex, path, depth) AS (
          SELECT CAST(:start AS STRING), CAST(:start AS STRING), 0
          UNION ALL
          SELECT CAST(s.dst AS STRING), concat(w.path, '/', s.dst), w.depth + 1
          FROM walk w JOIN {steps} s ON CAST(s.src AS STRING) = w.vertex WHERE w.depth < :depth
        )
        SELECT vertex, path, depth FROM walk ORDER BY path
        """,
        args={"start": start, "depth": depth}, steps=edges.select("src", "dst").distinct(),
    )


@dataclass(frozen=True)
class Shape:
    """How a graph's edges are read: both ways or one, with weights or without, and how many a vertex should have."""

    undirected: bool = False
    weighted: bool = False
    most_edges: int | None = None

    def edges(self, edges: DataFrame) -> DataFrame:
        out = edges if self.weighted else edges.withColumn("weight", F.lit(None).cast(edges.schema["weight"].dataType))
        return undirected(out) if self.undirected else out

    def crowded(self, edges: DataFrame) -> DataFrame:
        """(vertex, edges) of vertices with more outgoing edges than they should have."""
        n = self.edges(edges).groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("edges"))
        return n.filter(F.lit(False) if self.most_edges is None else F.col("edges") > self.most_edges)


UNDIRECTED, WEIGHTED, UNDIRECTED_WEIGHTED = Shape(undirected=True), Shape(weighted=True), Shape(undirected=True, weighted=True)


def visible(log: DataFrame, lsn: int) -> DataFrame:
    """The edges of a change log (edge_id, src, label, dst, weight, is_deleted, txn_id, commit_lsn, seq) as of lsn."""
    return mvcc.visible(log, lsn, keys=("src", "label", "edge_id"))


def vacuum(log: DataFrame, watermark: int) -> DataFrame:
    return mvcc.vacuum(log, watermark, keys=("src", "label", "edge_id"))

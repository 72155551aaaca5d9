import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions.boxes import Box, Box3
from loomstone.operators import fulltext, graph, kv, maintenance, spatial, timeseries, vector
from loomstone.operators.membership import Bloom, Composite, Member

SERIES = "series string, ts long, value string"


def test_batches_with_ranges_and_merges(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    ops = [(0, "put", "a", "9"), (1, "delete", "a", None), (2, "put", "c", "3"), (3, "merge", "b", "x")]
    kind = "seq int, op string, key string, value string"
    assert {tuple(r) for r in kv.apply_batch(state, spark.createDataFrame(ops, kind)).collect()} == {("b", "2"), ("c", "3")}
    more = [(4, "range_delete", "b", "d"), (5, "put", "b", "7"), (6, "range_delete", "x", "z"), (7, "merge", "b", "y")]
    assert {tuple(r) for r in kv.apply_batch(state, spark.createDataFrame(ops + more, kind)).collect()} == {("b", "7")}


def test_many_range_deletes(spark, monkeypatch):
    monkeypatch.setattr(kv, "RANGES", 3)
    state = spark.createDataFrame([(f"{k:03d}", "v") for k in range(200)], "key string, value string")
    ops = spark.createDataFrame([(k, "range_delete", f"{20 * k:03d}", f"{20 * k + 10:03d}") for k in range(10)], "seq int, op string, key string, value string")
    assert sorted(int(r["key"]) for r in kv.apply_batch(state, ops).collect()) == [k for k in range(200) if k % 20 >= 10]


def test_range_delete_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    assert kv.range_delete(df, "b").count() == 2 and kv.range_delete(df).count() == 1 and kv.range_count(df, high="a", high_open=False).first()["deleted"] == 1


def test_cursor(spark):
    c = kv.Cursor(spark.createDataFrame([(k, k * 2) for k in (5, 1, 9)], "key int, value int"))
    assert not c.next() and c.first() and (c.key, c.value) == (1, 2) and c.next() and c.next() and c.key == 9 and not c.next() and c.key is None
    assert c.seek(2) and c.key == 5 and c.prev() and c.key == 1 and not c.prev()
    assert c.seek_prev(8) and c.key == 5 and c.last() and c.key == 9 and not c.seek(10)


def test_phrases_in_long_texts(spark):
    long = spark.createDataFrame([("l", " ".join(f"w{i % 50}" for i in range(20_000)) + " lazy cat"), ("m", "cat lazy " * 10_000), ("e", ""), ("n", None)], "doc_id string, text string")
    assert [r["doc_id"] for r in fulltext.phrase(long, ["w49", "lazy", "cat"]).collect()] == ["l"] and fulltext.phrase(long, []).count() == 4


def brute_cycles(pairs):
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    more = True
    while more:
        more = False
        for a in reach:
            new = set().union(reach[a], *(reach.get(b, set()) for b in reach[a]))
            more |= new != reach[a]
            reach[a] = new
    return {a for a in reach if a in reach[a]}


def test_cycles(spark):
    r = random.Random(4)
    shapes = [
        [(i, i + 1) for i in range(12)], [(i, (i + 1) % 9) for i in range(9)] + [(7, 200), (200, 201), (201, 300), (300, 301), (301, 300)],
        [(1, 1), (1, 2), (2, 3)], [(r.randrange(25), r.randrange(25)) for _ in range(35)],
    ]
    for pairs in shapes:
        df = spark.createDataFrame([*pairs, (None, 3)], "src int, dst int")
        assert {x["vertex"] for x in graph.on_cycles(df).collect()} == brute_cycles(pairs)
    with pytest.raises(RuntimeError, match="rounds"):
        graph.on_cycles(spark.createDataFrame(shapes[0], "src int, dst int"), rounds=3)


def test_graph_shapes_and_index_checks(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 4 else "b", "l", "c", 1.0) for i in range(6)], "edge_id string, src string, label string, dst string, weight double")
    assert graph.UNDIRECTED.edges(df).count() == 12 and graph.Shape(most_edges=3).crowded(df).first()["vertex"] == "a" and graph.WEIGHTED.crowded(df).count() == 0
    post = fulltext.postings(spark.createDataFrame([("d", "lazy fox"), ("g", "gone now")], "doc_id string, text string"))
    docs = spark.createDataFrame([("d", "lazy fox"), ("u", "unseen")], "doc_id string, text string")
    assert {r["problem"]: r["n"] for r in fulltext.verify(docs, post).collect()} == {"dangling": 1, "unindexed": 1, "repeated position": 0}
    assert fulltext.vacuum(post, docs).count() == 2


def test_two_walks_at_once(spark):
    one = spark.createDataFrame([("r", "a"), ("a", "b")], "src string, dst string")
    two = spark.createDataFrame([("r", "x")], "src string, dst string")
    a, b = graph.preorder(one, "r", 5), graph.preorder(two, "r", 5)
    assert [r["vertex"] for r in a.collect()] == ["r", "a", "b"] and [r["vertex"] for r in b.collect()] == ["r", "x"]


def test_ranks_and_boxes_in_space(spark):
    df = spark.createDataFrame([((i * 37) % 101, i) for i in range(1000)], "x int, id int").repartition(5)
    got = spatial.ranked(df, "x", "id").orderBy("x", "id").collect()
    assert [r["rank"] for r in got] == list(range(1000)) and got[0]["total"] == 1000
    a, b = Box3(Box.lit(0, 0, 2, 2), F.lit(0.0), F.lit(1.0)), Box3(Box.lit(1, 1, 1.5, 1.5), F.lit(0.5), F.lit(3.0))
    row = spark.range(1).select(a.volume(), a.union(b).volume(), a.contains(b), a.meets(b), a.valid(), Box.empty().valid(), Box.empty().union(Box.lit(1, 2, 3, 4)).area()).first()
    assert tuple(row) == (4.0, 12.0, False, True, True, False, 4.0)


def test_plain_geometries_equal_the_full_reader():
    r = np.random.default_rng(3)
    raw = []
    for i in range(300):
        o, n = "<>"[i % 2], int(r.integers(1, 5))
        xy = r.standard_normal(2 * n)
        raw.append(struct.pack(f"{o}BI", o == "<", 1) + struct.pack(f"{o}2d", *xy[:2]) if i % 3 else struct.pack(f"{o}BII", o == "<", 2, n) + struct.pack(f"{o}{2 * n}d", *xy))
    raw += [raw[1][:-1], b"", None, struct.pack("<BII2d", 1, 2, 9, 1.0, 2.0), struct.pack("<BI2d", 1, 1, float("nan"), 1.0)]
    out = np.full((len(raw), 4), np.nan)
    rest = spatial._plain_boxes(raw, out).tolist()
    assert len(rest) < 10
    for i in rest:
        out[i] = spatial.wkb_box(raw[i]) or (np.nan,) * 4
    want = np.array([spatial.wkb_box(x) or (np.nan,) * 4 for x in raw])
    assert np.array_equal(out, want, equal_nan=True) and np.isnan(out[-5:]).all()


def test_insert_and_remove_boxes(spark):
    df = spark.createDataFrame([("p", 0.0, 0.0, 1.0, 1.0), ("q", 5.0, 5.0, 6.0, 6.0)], "id string, min_x double, min_y double, max_x double, max_y double")
    point = lambda x, y: bytearray(struct.pack("<BI2d", 1, 1, x, y))
    new = spark.createDataFrame([("p", point(2.0, 3.0)), ("n", point(7.0, 8.0)), ("bad", bytearray(b"x"))], "id string, wkb binary")
    got = {r["id"]: (r["min_x"], r["max_y"]) for r in spatial.insert_wkb(df, new).collect()}
    assert got == {"p": (2.0, 3.0), "q": (5.0, 6.0), "n": (7.0, 8.0)}
    assert spatial.remove(df, spark.createDataFrame([("q",), ("none",)], "id string")).count() == 1 and spatial.verify(df).filter("n > 0").count() == 0


def test_asof_by_buckets_equals_asof(spark):
    r = random.Random(2)
    probes = spark.createDataFrame([(f"s{r.randrange(3)}", r.randrange(-50, 400), i) for i in range(200)], "series string, ts long, id int")
    points = spark.createDataFrame([(f"s{i % 3}", t, str(t)) for i, t in enumerate(r.sample(range(0, 300), 60))], SERIES)
    want = {tuple(x) for x in timeseries.asof(probes, points).collect()}
    for size in (1, 50, 1000):
        assert {tuple(x) for x in timeseries.asof(probes, points, size=size).collect()} == want


def test_times_beyond_a_double(spark):
    big = spark.createDataFrame([("s", 2**62 + 7, "1"), ("s", -(2**62) - 7, "2")], SERIES)
    assert [r[0] for r in big.select(timeseries.bucket(F.col("ts"), 10)).collect()] == [(2**62 + 7) // 10, (-(2**62) - 7) // 10]
    assert timeseries.downsample(big, 2**62 + 1, 2**62 + 100, 3, "count", "value").first()["window_start"] == 2**62 + 7


def test_approximate_neighbours(spark):
    r = np.random.default_rng(6)
    centres = r.standard_normal((20, 16)) * 4
    x = centres[r.integers(0, 20, 1500)] + r.standard_normal((1500, 16)) * 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").cache()
    indexed, lists = vector.ivf(df, 16)
    indexed.cache()
    hit = [0, 0]
    for q in range(0, 1500, 150):
        want = {w["vec_id"] for w in vector.knn(df, x[q].tolist(), 10, "euclidean").collect()}
        hit[0] += len(want & {w["vec_id"] for w in vector.ann(df, x[q].tolist(), 10, length=6.0, tables=12).collect()})
        hit[1] += len(want & {w["vec_id"] for w in vector.probe(indexed, lists, x[q].tolist(), 10, 4).collect()})
    assert min(hit) >= 90  # of 100
    assert {r["problem"]: r["n"] for r in vector.verify(df, 16).collect()} == {"length": 0, "no number": 0, "repeated key": 0}


def test_bloom_keys_taken_back(spark):
    keys, some = (spark.range(n).withColumnRenamed("id", "k") for n in (1000, 10))
    bloom = Bloom.build(keys, "k", 1000)
    held = lambda b, df=keys: b.probe(df, "k").filter("maybe").count()
    back = bloom.roll_back(some, "k")
    assert held(back) == 990 and back.taken_back_count() == 10 and held(back.confirm(some, "k")) == 1000 and held(back.insert(some, "k")) == 1000
    assert held(back.vacuum(keys, "k")) >= 990 and held(back.vacuum(keys, "k"), some) <= 3 and held(bloom.clear()) == 0 and bloom.verify().filter("n > 0").count() == 0


def test_composites_ask_the_filter_first(spark):
    primary = spark.range(100).selectExpr("id AS key", "concat('v', id) AS value")
    even = spark.range(0, 100, 2).withColumnRenamed("id", "key")
    keys = spark.range(0, 200, 5).withColumnRenamed("id", "key")
    exact, loose = Composite(primary, [Member.of(even, 1000)]), Composite(primary, [Member(Bloom.build(even, "key", 1000))])
    want = {k for k in range(0, 100, 10)}
    got = {r["key"] for r in loose.bloom_first(keys).collect()}
    assert {r["key"] for r in exact.bloom_first(keys).collect()} == want and want <= got <= set(range(0, 100, 5))
    assert "might_contain" not in exact.bloom_first(keys)._jdf.queryExecution().toString() and Composite(primary).might_contain(keys).filter("maybe").count() == 40


def test_maintenance(spark, tmp_path):
    df, seen = maintenance.observed(spark.range(10).withColumn("bytes", F.lit(3)), "load", total=F.sum("bytes"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "total": 30}
    files = spark.createDataFrame([("f1", 0, 9, 100), ("f2", 10, 19, 100), ("f3", 15, 30, 100)], "file string, min_key int, max_key int, bytes int")
    rows = spark.range(31).select(F.col("id").cast("int").alias("key"))
    assert [r["file"] for r in maintenance.compact_range(files, rows, f"{tmp_path}/c", 10, 20).collect()] == ["f2"] and spark.read.parquet(f"{tmp_path}/c").count() == 11
    assert tuple(maintenance.write_amplification(files, files.limit(0)).first()) == (300, 0, 1.0) and maintenance.vacuum_report(rows, rows.limit(5)).first()["removed"] == 26

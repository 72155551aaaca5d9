import struct

import pytest
from pyspark.sql import functions as F

from loomstone.functions.boxes import Box, hilbert
from loomstone.functions.numeric import parse_numeric, unzigzag, zigzag
from loomstone.functions.tokens import simple, stem, stemming, whitespace
from loomstone.operators import fulltext, graph, kv, mvcc, spatial, timeseries, vector
from loomstone.operators.membership import Bloom, bits_for, hashes_for
from loomstone.plans.predicates import compile_predicate, p

SERIES = "series string, ts long, value string"


def series(spark, points, name="s"):
    return spark.createDataFrame([(name, t, v) for t, v in points], SERIES)


def numbers(df):
    return df.withColumn("n", parse_numeric(F.col("value")))


@pytest.mark.parametrize(
    ("text", "want"),
    [("10.5", 10.5), ("temperature:20.0", 20.0), ('{"value": 30.5}', 30.5), ("1.", 1.0), (".5", 0.5), ("+1", 1.0), (" 7 ", 7.0), ("1d", None), ("not-a-number", None), ("", None), ('{"value":"5","avg":7}', 7.0), ('{"sum":2}', 2.0), ("1e3", 1000.0), ("-inf", float("-inf")), (None, None), ("a:b:4", 4.0), ("[1]", None)],
)
def test_parse_numeric(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_numeric(F.col("t"))).first()[0] == want


def test_aggregates(spark):
    df = numbers(timeseries.scan(series(spark, [(100, "10.5"), (200, "temperature:20.0"), (300, '{"value": 30.5}'), (400, "40")]), 0, 500, "s"))
    assert [timeseries.aggregate(df, k, "n").first()[0] for k in timeseries.KINDS] == [101.0, 25.25, 10.5, 40.0, 4]
    odd = numbers(series(spark, [(100, "12"), (200, "not-a-number"), (300, "18")]))
    assert [timeseries.aggregate(odd, k, "n").first()[0] for k in timeseries.KINDS] == [30.0, 15.0, 12.0, 18.0, 3]
    none = numbers(series(spark, []))
    assert [timeseries.aggregate(none, k, "n").first()[0] for k in timeseries.KINDS] == [None, None, None, None, 0]
    with pytest.raises(ValueError, match="unknown"):
        timeseries.aggregate(none, "median", "n")


def test_downsample(spark):
    df = numbers(series(spark, [(10, "10"), (20, "20"), (70, "30"), (80, "50")]))
    assert sorted(map(tuple, timeseries.downsample(df, 0, 120, 60, "avg", "n").collect())) == [(0, 15.0, 60), (60, 40.0, 120)]
    odd = numbers(series(spark, [(10, "bad"), (20, "still-bad"), (70, "ignored")]))
    assert sorted(map(tuple, timeseries.downsample(odd, 0, 100, 60, "count", "n").collect())) == [(0, 2, 60), (60, 1, 100)]
    with pytest.raises(ValueError, match="interval"):
        timeseries.downsample(df, 0, 1, 0, "avg", "n")


def test_scan_is_half_open_and_latest_inclusive(spark):
    df = series(spark, [(t, str(t)) for t in range(0, 1000, 100)])
    assert [r["ts"] for r in timeseries.scan(df, 200, 600).orderBy("ts").collect()] == [200, 300, 400, 500]
    assert timeseries.scan(df, 100, 301).count() == 3
    points = series(spark, [(1000, "a"), (2000, "b"), (3000, "c")])
    assert timeseries.latest_before(points, 2500).first()["ts"] == 2000
    assert timeseries.latest_before(points, 2000).first()["ts"] == 2000
    assert timeseries.latest_before(points, 999).count() == 0


def test_asof_takes_equal_times_and_gives_null_before_the_first(spark):
    probes = spark.createDataFrame([("s", 5, 1), ("s", 10, 2), ("s", 15, 3), ("x", 15, 4)], "series string, ts long, id int")
    got = timeseries.asof(probes, series(spark, [(10, "a"), (14, "b")]))
    assert {r["id"]: (r["asof_value"], r["asof_ts"]) for r in got.collect()} == {1: (None, None), 2: ("a", 10), 3: ("b", 14), 4: (None, None)}


def test_last_write_buckets_and_retention(spark):
    df = spark.createDataFrame([("s", 1, "a", 1), ("s", 1, "b", 2), ("s", -1, "c", 1)], SERIES + ", seq int")
    assert {(r["ts"], r["value"]) for r in timeseries.last_write(df).collect()} == {(1, "b"), (-1, "c")}
    assert {r["b"] for r in df.select(timeseries.bucket(F.col("ts"), 10).alias("b")).collect()} == {0, -1}
    assert timeseries.keep_last(df.select("series", "ts"), 1).first()["ts"] == 1


def test_codecs_round_trip(spark):
    rows = [("s", i, 1000 + 7 * i * i) for i in range(50)] + [("t", 0, -5)]
    df = spark.createDataFrame(rows, "series string, pos long, v long")
    coded = timeseries.delta_of_delta(df, "v", ts="pos").drop("v")
    assert {(r["series"], r["pos"], r["value"]) for r in timeseries.undelta_of_delta(coded).collect()} == set(rows)
    flat = timeseries.delta(df, "v", ts="pos").drop("v")
    assert {(r["series"], r["pos"], r["value"]) for r in timeseries.undelta(flat).collect()} == set(rows)
    n = spark.createDataFrame([(v,) for v in (0, -1, 1, -2, 2**62, -(2**62))], "n long").withColumn("z", zigzag(F.col("n")))
    assert [(r["z"], r["b"]) for r in n.withColumn("b", unzigzag(F.col("z"))).collect()][:4] == [(0, 0), (1, -1), (2, 1), (3, -2)]
    d = spark.createDataFrame([("s", 1, 1.5), ("s", 2, -0.0), ("s", 3, 1e300)], "series string, ts long, value double")
    assert [r["value"] for r in timeseries.unxor_bits(timeseries.xor_bits(d)).orderBy("ts").collect()] == [1.5, -0.0, 1e300]


def test_tokens_and_stems(spark):
    df = spark.createDataFrame([("The quick Brown-fox's  jumps, a É9 x",)], "t string")
    assert df.select(simple(F.col("t"))).first()[0] == ["quick", "brownfoxs", "jumps", "é9"]
    assert df.select(whitespace(F.col("t"))).first()[0] == ["The", "quick", "Brown-fox's", "jumps,", "a", "É9", "x"]
    words = {"classes": "class", "flies": "fl", "ties": "ties", "cats": "cat", "glass": "glass", "agreed": "agree", "feed": "feed", "jumped": "jump", "red": "red", "running": "runn", "sing": "sing", "happy": "happi", "by": "by", "nation": "nation", "relation": "rela", "kindness": "kind", "useful": "use"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got} == words
    assert df.select(stemming(F.col("t"))).first()[0][2] == "jump"


def test_search(spark):
    df = spark.createDataFrame([("doc1", "The quick brown fox jumps over the lazy dog"), ("doc2", "The lazy cat sleeps on the warm mat")], "doc_id string, text string")
    assert [(r["doc_id"], r["score"]) for r in fulltext.search(df, ["lazy"], 10).collect()] == [("doc1", 0.0), ("doc2", 0.0)]
    assert round(fulltext.search(df, ["fox", "fox"], 10).first()["score"], 6) == 0.60206
    assert fulltext.search(df, ["absent"], 10).count() == 0
    assert fulltext.phrase(df, ["lazy", "cat"]).first()["doc_id"] == "doc2"
    fields = spark.createDataFrame([("d", [("title", "big cat", 2.0)])], "doc_id string, fields array<struct<name string, text string, boost double>>")
    assert [r["term"] for r in fulltext.field_postings(fields).collect()] == ["big", "cat"]


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(3)], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in vector.knn(df, [1.0, 0, 0, 0], 2).collect()] == [0, 1]
    new = spark.createDataFrame([(0, [1.0] * 4), (9, [1.0])], "vec_id int, embedding array<float>")
    assert {(r["vec_id"], r["reason"]) for r in vector.insert_errors(df, new, 4).collect()} == {(0, "duplicate"), (9, "dimension")}


def grid(spark):
    return spark.createDataFrame([(f"p{x}_{y}", float(x), float(y), float(x), float(y)) for x in range(10) for y in range(10)], "id string, min_x double, min_y double, max_x double, max_y double")


def test_boxes(spark):
    df = grid(spark)
    assert spatial.hits(df, (2, 2, 5, 5)).count() == 16
    assert [r["id"] for r in spatial.nearest(df, -1, -1, 2).collect()] == ["p0_0", "p0_1"]
    met = spatial.box_join(df, df, 0.7)
    assert met.count() == 100 and met.filter("left_id <> right_id").count() == 0
    assert spatial.str_tiles(df, 4, 5).groupBy("slice", "tile").count().count() == 20
    a, b = Box.lit(0, 0, 2, 2), Box.lit(1, 1, 3, 4)
    row = df.limit(1).select(a.overlap_area(b), a.area_increase(b), a.contains(b), a.max_distance(F.lit(0.0), F.lit(0.0))).first()
    assert (row[0], row[1], row[2], round(row[3], 6)) == (1.0, 8.0, False, 2.828427)
    cells = spark.range(256).select((F.col("id") % 16).cast("double").alias("x"), F.floor(F.col("id") / 16).cast("double").alias("y"))
    h = [tuple(r) for r in cells.select(hilbert(F.col("x"), F.col("y"), 0.0, 15.0, 4), "x", "y").collect()]
    path = [(x, y) for _, x, y in sorted(h)]
    assert sorted(k for k, _, _ in h) == list(range(256)) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_wkb(spark):
    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 5.0, 3.0, -1.0)
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    polygon = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">2d", *q) for q in ring)
    multi = struct.pack("<BII", 1, 4, 2) + struct.pack("<BI2d", 1, 1, 1.0, 2.0) + struct.pack(">BI2d", 0, 1, 7.0, -2.0)
    df = spark.createDataFrame([(1, line), (2, polygon), (3, multi), (4, b"\x01junk"), (5, None)], "id int, w binary")
    got = {r["id"]: tuple(r["m"]) for r in df.select("id", spatial.wkb_boxes(F.col("w")).alias("m")).collect()}
    assert got[1] == (0.0, -1.0, 3.0, 5.0) and got[2] == (0.0, 0.0, 4.0, 4.0) and got[3] == (1.0, -2.0, 7.0, 2.0)
    assert all(v is None or v != v for v in (*got[4], *got[5]))


def test_graph(spark):
    e = [("1", "alice", "knows", "bob", 1.0), ("2", "bob", "knows", "charlie", 1.0), ("3", "charlie", "knows", "dave", 1.0), ("4", "alice", "knows", "eve", 2.0), ("5", "dave", "knows", "bob", 1.0)]
    df = spark.createDataFrame(e, "edge_id string, src string, label string, dst string, weight double")
    assert {(r["vertex"], r["depth"]) for r in graph.bfs(df, "alice").collect()} == {("alice", 0), ("bob", 1), ("eve", 1), ("charlie", 2), ("dave", 3)}
    assert {r["vertex"] for r in graph.bfs(df, "alice", most=1).collect()} == {"alice", "bob", "eve"}
    assert {r["vertex"] for r in graph.on_cycles(df).collect()} == {"bob", "charlie", "dave"}
    assert graph.undirected(df).filter("src = 'eve'").first()["weight"] is None
    assert graph.vertices(df).count() == 5 and graph.stats(df).first()["edges"] == 5


def test_versions(spark):
    rows = [("k", "version1", False, 1, 10, 1), ("k", "version2", False, 2, 20, 2), ("k", "version3", False, 3, None, 3), ("d", "x", False, 1, 10, 1), ("d", None, True, 2, 20, 2)]
    log = spark.createDataFrame(rows, mvcc.LOG_SCHEMA)
    at = lambda lsn, **how: {(r["key"], r["value"]) for r in mvcc.visible(log, lsn, **how).collect()}
    assert at(9) == set() and at(10) == {("k", "version1"), ("d", "x")} and at(25) == {("k", "version2")}
    assert at(25, active=(2,)) == {("k", "version1"), ("d", "x")} and at(10, own=3) == {("k", "version3"), ("d", "x")}
    assert {(r["key"], r["seq"]) for r in mvcc.vacuum(log, 30).collect()} == {("k", 2), ("k", 3), ("d", 2)}
    assert {(r["key"], r["value"]) for r in mvcc.visible(mvcc.commit(log, 3, 30), 30).collect()} == {("k", "version3")}


def test_scans_on_binary_keys(spark):
    df = spark.createDataFrame([(bytearray(b"charlie"), 1), (bytearray(b"alice"), 2), (bytearray(b"bob"), 3), (bytearray(b"\xff"), 4)], "key binary, value int")
    assert [r["value"] for r in kv.scan(df).collect()] == [2, 3, 1, 4] and [r["value"] for r in kv.scan(df, reverse=True).collect()] == [4, 1, 3, 2]
    assert kv.seek(df, bytearray(b"az")).first()["value"] == 3 and kv.seek_back(df, bytearray(b"az")).first()["value"] == 2
    users = spark.createDataFrame([(f"user{i:03d}", i) for i in range(20)] + [("admin:1", 99)], "key string, value int")
    assert kv.between(users, "user005", "user010", high_open=False).count() == 6 and kv.prefix(users, "user").count() == 20


def test_bloom(spark):
    assert bits_for(0.01) == 10 and hashes_for(10) == 7
    keys = spark.range(1000).withColumnRenamed("id", "k")
    bloom = Bloom.build(keys, "k", 1000)
    assert bloom.probe(keys, "k").filter("NOT maybe").count() == 0
    wrong = bloom.probe(spark.range(10_000, 30_000).withColumnRenamed("id", "k"), "k").filter("maybe").count()
    assert wrong < 400
    both = bloom.merge(Bloom.build(spark.range(5000, 5100).withColumnRenamed("id", "k"), "k", 1000))
    assert both.probe(spark.range(5000, 5100).withColumnRenamed("id", "k"), "k").filter("NOT maybe").count() == 0
    assert 0 < bloom.stats().first()["fill"] < 1
    with pytest.raises(ValueError, match="semi-join"):
        Bloom.build(keys, "k", 10**9)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "b")], "n int, s string")
    count = lambda x: df.filter(compile_predicate(x)).count()
    assert count(p("or", p("prefix", "s", "a"), p("is_null", "s"))) == 2
    assert count(p("and")) == 3 and count(p("or")) == 0 and count(p("not", p("in", "n", (1, 2)))) == 1
    assert count(p("range", "n", 1, 3, False, True)) == 2
    with pytest.raises(ValueError, match="unknown"):
        compile_predicate(p("like", "s"))


def test_batches(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    ops = spark.createDataFrame([(0, "put", "a", "9"), (1, "delete", "a", None), (2, "put", "c", "3"), (3, "merge", "b", "x")], "seq int, op string, key string, value string")
    assert {tuple(r) for r in kv.apply_batch(state, ops.filter("op <> 'merge'")).collect()} == {("b", "2"), ("c", "3")}
    assert tuple(kv.batch_report(ops).first()) == (4, 3, 1, 4)


def test_field_scores_and_lists(spark):
    docs = spark.createDataFrame([("a", [("title", "fox", 3.0), ("body", "fox den", 1.0)]), ("b", [("body", "fox", 1.0)]), ("c", [("body", "den", 1.0)]), ("d", [])], "doc_id string, fields array<struct<name string, text string, boost double>>")
    got = {r["doc_id"]: round(r["score"], 6) for r in fulltext.score_fields(docs, ["fox"]).collect()}
    w = 0.124939  # log10(4 / 3): three entries hold the word
    assert got == {"a": pytest.approx(2 * w * 4, abs=1e-5), "b": pytest.approx(w, abs=1e-5)}
    df = spark.createDataFrame([(i, [float(i % 5) * 10, float(i)]) for i in range(100)], "vec_id int, embedding array<float>")
    indexed, centroids = vector.ivf(df, 5)
    exact = [r["vec_id"] for r in vector.knn(df, [20.0, 50.0], 3, "euclidean").collect()]
    assert [r["vec_id"] for r in vector.probe(indexed, centroids, [20.0, 50.0], 3, 5).collect()] == exact

import pytest

from loomstone.sources import append_log, catalog
from loomstone.sources.catalog import AlreadyExists, Conflict, Database, InvalidOperation, NotFound
from loomstone.sources.tables import blobs


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"file://{tmp_path}/db")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def state(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_tables_and_metadata(spark, db):
    t = db.create_table("users", "btree", owner="me")
    assert db.table_id("users") == t and db.info(t)["kind"] == "btree" and db.table_id("none") is None
    with pytest.raises(AlreadyExists):
        db.create_table("users")
    with pytest.raises(InvalidOperation):
        db.create_table("x", "rope")
    db.set_metadata("a", "1", t)
    db.set_metadata("version", "2")
    again = Database.open(spark, db.path)
    assert again.all_metadata(t) == {"owner": "me", "a": "1"} and again.get_metadata("version") == "2"
    again.remove_metadata("a", t)
    again.clear_metadata()
    assert again.all_metadata() == {} and [r["name"] for r in again.tables().collect()] == ["users"]
    again.drop_table(t)
    with pytest.raises(NotFound):
        again.info(t)
    with pytest.raises(AlreadyExists):
        Database.create(spark, db.path)
    with pytest.raises(NotFound):
        Database.open(spark, db.path + "x")


def test_transactions(spark, db):
    t = db.create_table("kv")
    w = db.begin()
    w.put(t, rows(spark, ("a", "1"), ("b", "2")))
    assert state(w.read(t)) == {"a": "1", "b": "2"} and state(db.begin().read(t)) == {}
    w.commit()
    db.create_snapshot(" first ")
    w = db.begin()
    w.update(t, rows(spark, ("a", "9")))
    w.delete(t, rows(spark, ("b", "")))
    w.insert(t, rows(spark, ("c", "3")))
    assert state(w.read(t)) == {"a": "9", "c": "3"}
    with pytest.raises(AlreadyExists):
        w.insert(t, rows(spark, ("c", "4")))
    with pytest.raises(NotFound):
        w.update(t, rows(spark, ("zz", "4")))
    w.commit()
    assert state(db.begin().read(t)) == {"a": "9", "c": "3"}
    assert state(db.begin(at=db.snapshots()["first"]).read(t)) == {"a": "1", "b": "2"}
    with pytest.raises(InvalidOperation):
        db.begin(at=77)
    assert db.vacuum(t) == 0
    db.release_snapshot("first")
    assert db.vacuum(t) == 0  # the newest versions are at the watermark itself
    w = db.begin()
    w.put(t, rows(spark, ("a", "10")))
    w.commit()
    assert db.vacuum(t) >= 1 and state(db.begin().read(t)) == {"a": "10", "c": "3"}
    w = db.begin()
    w.delete(t, rows(spark, ("c", "")))
    w.commit()
    assert state(db.begin().read(t)) == {"a": "10"} and db.verify(t).filter("n > 0").count() == 0
    log = db.create_table("log", "append_log")
    assert {r["name"]: r["removed"] for r in db.vacuum_all().collect()}["log"] is None and db.table_count() == 2 and db.has_table(log)


def test_conflicts_and_ends(spark, db):
    t = db.create_table("kv")
    one, two = db.begin(), db.begin()
    one.put(t, rows(spark, ("a", "1")))
    two.put(t, rows(spark, ("a", "2")))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    with pytest.raises(InvalidOperation):
        one.put(t, rows(spark, ("a", "1")))
    r = db.begin()
    r.delete_range(t, "a", "b")
    assert state(r.read(t)) == {}
    r.rollback()
    assert state(db.begin().read(t)) == {"a": "1"}
    series = db.create_table("series", "time_series")
    with pytest.raises(InvalidOperation):
        db.begin().put(series, rows(spark, ("a", "1")))
    with pytest.raises(InvalidOperation):
        db.begin(writes=False).put(t, rows(spark, ("a", "1")))
    with pytest.raises(AlreadyExists):
        db.create_snapshot("s") and db.create_snapshot("s")
    with pytest.raises(InvalidOperation):
        db.create_snapshot("  ")


def test_capabilities(spark):
    df = catalog.capabilities(spark)
    assert df.filter("kind = 'btree' AND capability = 'reverse'").first()["supported"]


def test_append_log_and_blobs(spark, tmp_path):
    path = f"{tmp_path}/log"
    for s in range(3):
        append_log.append(spark.createDataFrame([(f"k{i}", str(s), s * 10 + i) for i in range(4)], "key string, value string, seq long"), path, s)
    log = append_log.read(spark, path)
    assert log.count() == 12 and {r["value"] for r in append_log.state(log).collect()} == {"2"}
    assert {r["segment"] for r in append_log.keep_segments(log, 1).collect()} == {1, 2}
    rolled = f"{tmp_path}/rolled"
    more = lambda k: spark.createDataFrame([(f"k{k}", "v", k)], "key string, value string, seq long")
    assert [append_log.put(more(k), rolled, 2) for k in range(5)] == [0, 0, 1, 1, 2]
    assert append_log.delete(spark.createDataFrame([("k1", 9)], "key string, seq long"), rolled, 2) == 2
    log = append_log.read(spark, rolled)
    assert state(append_log.state(log)).keys() == {"k0", "k2", "k3", "k4"} and state(append_log.state_at(log, 1)).keys() == {"k0", "k1"}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.bin").write_bytes(b"123")
    (tmp_path / "b" / "two.bin").write_bytes(b"1" * 50)
    assert {r["length"] for r in blobs(spark, f"{tmp_path}/b").collect()} == {3, 50} and blobs(spark, f"{tmp_path}/b", 10).count() == 1


def test_wal(spark, tmp_path):
    from loomstone.operators import mvcc
    from loomstone.sources.wal import Locked, Wal

    log = Wal.open(spark, f"{tmp_path}/wal")
    for txn in (1, 2, 3):
        log.begin(txn)
        log.write(txn, 7, "put", spark.range(3).selectExpr("id AS n", "cast(id AS string) AS key", "'v' AS value"))
    log.commit(1)
    log.rollback(2)
    log.checkpoint()
    records = log.records()
    assert records.count() == 15 and records.select("lsn").distinct().count() == 15
    assert {(r["txn_id"], r["key"]) for r in mvcc.replay(records).collect()} == {(1, "0"), (1, "1"), (1, "2")}
    assert [r["txn_id"] for r in mvcc.still_active(records).collect()] == [3]
    assert log.truncated(13).count() == 3
    with pytest.raises(ValueError, match="unknown"):
        log.write(1, 7, "rename", spark.range(1))
    with pytest.raises(ValueError, match="gaps"):
        log.write(3, 7, "put", spark.range(5).filter("id <> 2").selectExpr("id AS n", "'k' AS key", "'v' AS value"))
    with pytest.raises(Locked):
        Wal.open(spark, f"{tmp_path}/wal")
    log.close()
    with pytest.raises(Locked):
        log.begin(9)
    again = Wal.open(spark, f"{tmp_path}/wal")
    assert again.next_lsn == 21
    assert Wal.open(spark, f"{tmp_path}/wal", take_over=True).next_lsn == 21


def test_a_failed_commit_leaves_no_trace(spark, db, monkeypatch):
    one, two = db.create_table("one"), db.create_table("two")
    w = db.begin()
    w.put(one, rows(spark, ("lost", "1")))
    w.put(two, spark.createDataFrame([("x", "1")], "key string, value string").selectExpr("key", "raise_error('no') AS value"))
    with pytest.raises(Exception, match="no"):
        w.commit()
    w = db.begin()
    w.put(one, rows(spark, ("kept", "1")))
    lsn = w.commit()
    assert state(db.begin().read(one)) == {"kept": "1"} and Database.open(spark, db.path).state["lsn"] == lsn
    # a writer that dies after its rows were written, before they are published
    w = db.begin()
    w.put(one, rows(spark, ("dead", "1")))
    monkeypatch.setattr(Database, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        w.commit()
    monkeypatch.undo()
    assert state(Database.open(spark, db.path).begin().read(one)) == {"kept": "1"}


def test_two_handles_on_one_folder(spark, db):
    t = db.create_table("kv")
    other = Database.open(spark, db.path)
    a, b, c = db.begin(), other.begin(), other.begin()
    a.put(t, rows(spark, ("k", "a")))
    b.put(t, rows(spark, ("k", "b")))
    c.put(t, rows(spark, ("m", "c")))
    assert a.commit() == 1
    with pytest.raises(Conflict):
        b.commit()
    assert c.commit() == 2  # published on the state that a left
    assert state(other.begin().read(t)) == {"k": "a", "m": "c"} == state(db.begin().read(t))
    n = db.create_table("n")
    assert other.create_table("p") == n + 1
    with pytest.raises(AlreadyExists):
        other.create_table("n")


def test_a_vacuum_that_dies_keeps_the_old_rows(spark, db, monkeypatch):
    t = db.create_table("kv")
    for v in "123":
        db.table(t).put(rows(spark, ("k", v)))
    monkeypatch.setattr(Database, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        db.vacuum(t)
    monkeypatch.undo()
    again = Database.open(spark, db.path)
    assert state(again.begin().read(t)) == {"k": "3"} and again.vacuum(t) == 1 and state(again.table(t).read()) == {"k": "3"}


def test_isolation(spark, db):
    t, u = db.create_table("t"), db.create_table("u")
    db.table(t).put(rows(spark, ("a", "1")))
    for level in catalog.ISOLATION:
        x = db.begin(isolation=level)
        before = state(x.read(t))["a"]
        db.table(t).put(rows(spark, ("a", before + "x")))
        db.table(t).put(rows(spark, (f"phantom {level}", "1")))
        assert (state(x.read(t))["a"] != before) == (level in ("read_uncommitted", "read_committed")), level
        x.put(u, rows(spark, ("w", level)))
        if level in ("repeatable_read", "serializable"):
            with pytest.raises(Conflict):
                x.commit()
        else:
            x.commit()
    x = db.begin(isolation="repeatable_read")
    x.read(t)
    db.table(t).put(rows(spark, ("new", "1")))  # a phantom is no conflict here
    x.put(u, rows(spark, ("v", "1")))
    x.commit()
    with pytest.raises(InvalidOperation):
        db.begin(isolation="chaos")


def test_tables_of_all_kinds_in_one_transaction(spark, db):
    from loomstone.operators import fulltext, graph, spatial, timeseries, vector

    ids = {k: db.create_table(k, k) for k in ("vector", "spatial", "graph", "time_series", "full_text", "bloom")}
    w = db.begin()
    w.put(ids["vector"], spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "vec_id string, embedding array<double>"))
    w.put(ids["spatial"], spark.createDataFrame([("p", 0.0, 0.0, 1.0, 1.0)], "id string, min_x double, min_y double, max_x double, max_y double"))
    w.put(ids["graph"], spark.createDataFrame([("e", "x", "knows", "y", 2.0)], "edge_id string, src string, label string, dst string, weight double"))
    w.put(ids["time_series"], spark.createDataFrame([("s", 5, "7"), ("s", 6, "8")], "series string, ts long, value string"))
    w.put(ids["full_text"], spark.createDataFrame([("d", "lazy fox"), ("f", "busy bee")], "doc_id string, text string"))
    w.put(ids["bloom"], spark.createDataFrame([("k",)], "key string"))
    assert [r["vec_id"] for r in vector.knn(w.read(ids["vector"]), [1.0, 0.1], 1).collect()] == ["a"]  # own writes are seen
    assert db.begin().read(ids["vector"]).count() == 0
    w.commit()
    db.create_snapshot("s")
    w = db.begin()
    w.delete(ids["vector"], spark.createDataFrame([("a",)], "vec_id string"))
    w.delete(ids["time_series"], spark.createDataFrame([("s", 5)], "series string, ts long"))
    w.delete(ids["full_text"], spark.createDataFrame([("d",)], "doc_id string"))
    w.delete(ids["graph"], spark.createDataFrame([("x", "knows", "e")], "src string, label string, edge_id string"))
    w.commit()
    now, then = db.begin(), db.begin(at=db.snapshots()["s"])
    assert [r["vec_id"] for r in vector.knn(now.read(ids["vector"]), [1.0, 0.1], 2).collect()] == ["b"]
    assert [r["vec_id"] for r in vector.knn(then.read(ids["vector"]), [1.0, 0.1], 1).collect()] == ["a"]
    assert spatial.hits(now.read(ids["spatial"]), (0.5, 0.5, 2, 2)).count() == 1
    assert graph.outgoing(now.read(ids["graph"]), "x").count() == 0 and graph.outgoing(then.read(ids["graph"]), "x").first()["dst"] == "y"
    assert timeseries.scan(now.read(ids["time_series"]), 0, 10, "s").count() == 1 and timeseries.scan(then.read(ids["time_series"]), 0, 10, "s").count() == 2
    assert fulltext.search(now.read(ids["full_text"]), ["lazy"], 5).count() == 0 and fulltext.search(then.read(ids["full_text"]), ["lazy"], 5).count() == 1
    assert now.read(ids["bloom"]).count() == 1 and db.vacuum(ids["bloom"]) == 0


def test_large_values_and_options(spark, tmp_path):
    with Database.create(spark, f"file://{tmp_path}/z", compression="lz4") as db:
        t = db.create_table("blobs", "blob")
        w = db.begin()
        w.put_stream(t, "big", (bytes([i % 256]) * 1000 for i in range(50)), at_once=7)
        w.put(t, spark.createDataFrame([("small", 0, bytearray(b"x"))], "key string, part int, value binary"))
        w.commit()
        assert b"".join(db.begin().get_stream(t, "big")) == b"".join(bytes([i % 256]) * 1000 for i in range(50))
        w = db.begin()
        w.put_stream(t, "big", iter([b"new"]))
        w.commit()
        assert b"".join(db.begin().get_stream(t, "big")) == b"new" and [f for f in (tmp_path / "z" / f"table={t}").rglob("*.lz4*.parquet")]
    with pytest.raises(InvalidOperation):
        db.create_table("more")
    with pytest.raises(InvalidOperation):
        Database.create(spark, f"file://{tmp_path}/y", compression="rar")


def test_scopes_and_cursors(spark, db):
    t, b = db.create_table("kv"), db.create_table("b", "bloom")
    w = db.begin()
    w.on(t).put(rows(spark, *((k, k.upper()) for k in "ace")))
    w.on(b).put(spark.createDataFrame([("x",)], "key string"))
    asked = spark.createDataFrame([("x",), ("y",)], "key string")
    assert {r["key"]: r["found"] for r in w.on(b).holds(asked).collect()} == {"x": True, "y": False}  # seen by itself before it commits
    assert not any(r["found"] for r in db.begin().on(b).holds(asked).collect())
    c = w.cursor(t)
    assert c.seek("b") and (c.key, c.value) == ("c", "C") and c.next() and c.key == "e" and c.prev() and c.key == "c"
    w.on(t).delete(rows(spark, ("c", "")))
    assert w.cursor(t).seek("b") and state(w.on(t).read()) == {"a": "A", "e": "E"}
    with pytest.raises(InvalidOperation):
        w.cursor(b)


def test_range_deletes_are_counted(spark, db):
    t = db.create_table("kv")
    db.table(t).put(rows(spark, *((k, "v") for k in "abcde")))
    w = db.begin()
    assert w.delete_range(t, "b", "d", low_open=True, high_open=False) == 2
    assert w.delete_range(t, high="b") == 1
    w.commit()
    assert state(db.table(t).read()).keys() == {"b", "e"}

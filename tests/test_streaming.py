import datetime as dt

from pyspark.sql import functions as F

from loomstone.streaming import windows

SCHEMA = "id long, user long, ts timestamp, value double"


def log(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(k, u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), float(v)) for k, u, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        assert i >= 0
    return windows.read_log(spark, path, SCHEMA, files_per_batch=1)


def test_tumbling_equals_batch(spark, tmp_path):
    rows = [[(i, i % 3, i, i) for i in range(100)], [(100 + i, i % 3, 100 + i, i) for i in range(100)]]
    out = windows.run_once(windows.tumbling(log(spark, f"{tmp_path}/in", rows), "30 minutes", "1 hour"), "t1", f"{tmp_path}/c", "complete")
    assert sum(r["n"] for r in out.collect()) == 200 and out.count() == 7


def test_late_rows_are_left_out(spark, tmp_path):
    rows = [[(1, 1, 600, 1)], [(2, 1, 1200, 1)], [(3, 1, 0, 1)], [(4, 1, 3000, 1)]]
    out = windows.run_once(windows.tumbling(log(spark, f"{tmp_path}/in", rows), "10 minutes", "1 minute"), "t2", f"{tmp_path}/c")
    assert {r["window_start"].hour for r in out.collect()} == {10, 20}


def test_sessions_distinct_and_sliding(spark, tmp_path):
    rows = [[(1, 1, 0, 1), (1, 1, 1, 1), (2, 1, 5, 1), (3, 1, 60, 1)]]
    s = log(spark, f"{tmp_path}/in", rows)
    assert sorted(r["n"] for r in windows.run_once(windows.sessions(s, "10 minutes", "1 minute", "user"), "t3", f"{tmp_path}/a", "complete").collect()) == [1, 3]
    assert windows.run_once(windows.distinct_events(s, "id", "1 hour"), "t4", f"{tmp_path}/b").count() == 3
    assert windows.run_once(windows.sliding(s, "20 minutes", "10 minutes", "1 minute"), "t5", f"{tmp_path}/d", "complete").agg(F.sum("n")).first()[0] == 8


def test_running_last_keeps_state(spark, tmp_path):
    rows = [[(1, 1, 10, 5), (2, 2, 1, 7)], [(3, 1, 5, 6)], [(4, 1, 20, 8)]]
    out = windows.run_once(windows.running_last(log(spark, f"{tmp_path}/in", rows), "user"), "t6", f"{tmp_path}/c", "update").collect()
    last = {}
    for r in out:
        last.setdefault(r["user"], []).append(r["last_value"])
    assert last[2] == [7.0] and max(last[1]) == 8.0 and 6.0 not in last[1]


def test_to_parquet_once(spark, tmp_path):
    s = log(spark, f"{tmp_path}/in", [[(1, 1, 0, 1)], [(2, 1, 0, 1)]])
    for _ in range(2):
        windows.run_to(s, f"{tmp_path}/out", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2

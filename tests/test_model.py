"""Random histories against plain Python models."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from loomstone.operators import kv, mvcc

QUICK = settings(max_examples=3, phases=[Phase.generate], deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
KEY = st.sampled_from(["a", "ab", "b", "ba", "c"])


@QUICK
@given(ops=st.lists(st.tuples(st.sampled_from(["put", "delete"]), KEY, st.text("xyz", max_size=2)), min_size=1, max_size=12))
def test_batches_equal_a_dict(spark, ops):
    model = {"a": "1", "c": "3"}
    for op, k, v in ops:
        if op == "put":
            model[k] = v
        else:
            model.pop(k, None)
    state = spark.createDataFrame([("a", "1"), ("c", "3")], "key string, value string")
    log = spark.createDataFrame([(i, op, k, v if op == "put" else None) for i, (op, k, v) in enumerate(ops)], "seq int, op string, key string, value string")
    assert {r["key"]: r["value"] for r in kv.apply_batch(state, log).collect()} == model


@QUICK
@given(
    versions=st.lists(st.tuples(KEY, st.booleans(), st.integers(1, 4), st.one_of(st.none(), st.integers(1, 30))), min_size=1, max_size=14),
    lsn=st.integers(0, 31), active=st.sets(st.integers(1, 4), max_size=2),
)
def test_visibility_and_vacuum(spark, versions, lsn, active):
    rows = [(k, f"v{i}", gone, txn, at, i) for i, (k, gone, txn, at) in enumerate(versions)]
    log = spark.createDataFrame(rows, mvcc.LOG_SCHEMA)
    want = {}
    for k, v, gone, txn, at, _ in rows:
        if at is not None and at <= lsn and txn not in active:
            want[k] = None if gone else v
    want = {k: v for k, v in want.items() if v is not None}
    assert {r["key"]: r["value"] for r in mvcc.visible(log, lsn, tuple(active)).collect()} == want
    # chains whose order is that of their commits look alike, to readers at or after the watermark, when vacuumed
    ordered = [(k, v, gone, txn, i + 1, i) for i, (k, v, gone, txn, _, _) in enumerate(rows)]
    log = spark.createDataFrame(ordered, mvcc.LOG_SCHEMA)
    kept = mvcc.vacuum(log, lsn)
    at = lambda df: {(r["key"], r["value"]) for r in mvcc.visible(df, max(lsn, 1)).collect()}
    assert at(kept) == at(log)


@QUICK
@given(keys=st.sets(st.binary(max_size=3), min_size=1, max_size=12), low=st.binary(max_size=2), high=st.binary(max_size=2), probe=st.binary(max_size=3))
def test_scans_equal_sorted_lists(spark, keys, low, high, probe):
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    got = lambda x: [bytes(r["key"]) for r in x.collect()]
    order = sorted(keys)
    assert got(kv.scan(df)) == order and got(kv.scan(df, reverse=True)) == order[::-1]
    assert got(kv.scan(kv.between(df, bytearray(low), bytearray(high)))) == [k for k in order if low <= k < high]
    assert got(kv.seek(df, bytearray(probe))) == [k for k in order if k >= probe][:1]
    assert got(kv.seek_back(df, bytearray(probe))) == [k for k in order if k <= probe][-1:]
    assert got(kv.scan(kv.prefix(df, bytearray(probe)))) == [k for k in order if k.startswith(probe)]

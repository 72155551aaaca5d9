import hashlib
from collections import Counter

import pytest

from loomstone.llm import exact_dedup

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_groups(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (6, "é"), (7, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, keep_id int")
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(df, keep="max").collect())
    assert got == Counter({
        (1, 2, 2, False, sha("ab")): 1, (2, 2, 2, True, sha("ab")): 1, (3, 4, 2, False, sha("")): 1, (4, 4, 2, True, sha("")): 1,
        (5, 5, 1, True, sha("É")): 1, (6, 6, 2, True, sha("é")): 2, (7, 7, 1, True, sha("x" * 100_000)): 1,
    })
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact(df).collect()) == [1, 3, 5, 6, 7]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).collect() == [] and exact_dedup.drop_exact(df).collect() == []
    df = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b"), (None, "b"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()) == [(0, 1, True), (0, 2, False), (0, 2, True), (0, 2, True), (1, 2, True)]
    assert sorted((tuple(r) for r in exact_dedup.drop_exact(df).collect()), key=str) == [(1, "a"), (None, "b"), (None, None)]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "x"), (2, "x"), (2, "y"), (3, "Y"), (6, "e"), (6, "e"), (6, "E"), (7, "z"), (8, "q"), (8, "r")]
    df = spark.createDataFrame([(i, t, {"k": [k]}) for k, (i, t) in enumerate(rows)], "doc_id int, text string, kept_id map<string, array<int>>")
    got = exact_dedup.drop_exact(df)
    assert got.schema == df.schema
    stays = sorted((r["doc_id"], r["text"].lower()) for r in got.collect())
    assert stays == [(1, "x"), (2, "y"), (6, "e"), (7, "z"), (8, "q"), (8, "r")]
    assert sorted(map(str, got.collect())) == sorted(map(str, exact_dedup.drop_exact(df.repartition(7)).collect()))  # the same row of equal ids


def test_a_hot_group_and_many_texts(spark):
    rows = [(i, "Copy" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = {}
    for i, t in rows:
        want.setdefault(t.lower(), []).append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(df).collect()}
    for ids in want.values():
        assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(ids), len(ids), i == min(ids)) for i in ids)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact(df).collect()) == sorted(min(ids) for ids in want.values())


def test_bytes_are_compared_under_equal_hashes(spark):
    kind = "h binary, sha binary, text binary"
    exact_dedup._compare(spark.createDataFrame([(b"h", b"s", b"a"), (b"h", b"s", b"a"), (b"h", b"t", b"b")], kind))
    with pytest.raises(ValueError, match="two different texts"):
        exact_dedup._compare(spark.createDataFrame([(b"h", b"s", b"a"), (b"h", b"s", b"b")], kind))
    df = spark.createDataFrame([(i, f"t{i % 700}") for i in range(1000)], "doc_id long, text string")
    _, groups = exact_dedup._groups(df, "min")
    seen = {bytes(r["text"]) for r in exact_dedup._texts(df, groups.filter("group_size > 1")).collect()}
    assert seen >= {f"t{i}".encode() for i in range(300)} and len(seen) < 500

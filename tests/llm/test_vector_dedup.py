import numpy as np
import pytest

from loomstone.llm import vector_dedup


def made(seed=9, n=1500, dim=32, labels=4):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for i in range(0, 700):  # pairs and chains around the threshold, and tight groups
        j = int(r.integers(0, 60)) if i % 3 else i + 700
        e = r.standard_normal(dim)
        x[j + 750 if j < 60 else j] = x[i % 40] / np.linalg.norm(x[i % 40]) + e / np.linalg.norm(e) * r.choice([0.05, 0.2, 0.33, 0.39])
    label = r.integers(0, labels, size=n)
    label[700:] = label[np.arange(n - 700) % 40]
    return x.astype(np.float32), label


def brute(x, label):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    name = np.arange(len(x))
    while True:
        new = np.array([min([name[i], *name[link[i]]]) for i in range(len(x))])
        if (new == name).all():
            return link.sum(1), name
        name = new


def test_recall_against_brute_force(spark):
    x, label = made()
    links, name = brute(x, label)
    df = spark.createDataFrame([(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(6)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df).collect()}
    assert len(got) == len(x)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= links).all() and n.sum() >= 0.95 * links.sum()  # none below the threshold, recall
    same = np.mean([got[i]["component_id"] == name[i] for i in range(len(x))])
    assert same > 0.95 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_large_groups_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    r = np.random.default_rng(10)
    base = r.standard_normal(16)
    rows = [(i, (base + 0.02 * r.standard_normal(16)).tolist(), 1) for i in range(100)] + [(200 + i, base.tolist(), 1) for i in range(50)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(g["n_links"] == 149 and g["component_id"] == 0 for g in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1e300, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in odd], "vec_id long, embedding array<double>, label int, key string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(df).collect()}
    assert got[8] == (2, 8, True) and got[9] == (2, 8, False) and got[12] == (2, 8, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)) and len(got) == 12
    assert vector_dedup.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize(("n", "common"), [(3000, 0.8), (1500, 0.9)])
def test_recall_in_a_label_with_a_common_direction(spark, n, common):
    r = np.random.default_rng(11)
    e = r.standard_normal((n, 64))
    e[:, 0] = 0
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    near = (0.935 - common) / (1 - common)
    for i in range(200):  # isolated pairs at cosine 0.935
        w = e[200 + i] - (e[200 + i] @ e[i]) * e[i]
        e[200 + i] = near * e[i] + np.sqrt(1 - near**2) * w / np.linalg.norm(w)
    x = np.sqrt(1 - common) * e
    x[:, 0] = np.sqrt(common)
    links, name = brute(x, np.zeros(n, dtype=int))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {g["vec_id"]: g for g in vector_dedup.near_vectors(df).collect()}
    met = [got[i]["component_id"] == name[i] for i in range(n) if name[i] != i]
    assert len(met) >= 200 and np.mean(met) >= 0.95
    assert all(got[i]["n_links"] <= links[i] for i in range(n))


def test_windows_reach_over_small_partitions(spark):
    r = np.random.default_rng(12)
    dim, pairs = 64, 150
    x = r.standard_normal((2 * pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):  # isolated pairs at or a little above the threshold
        near = 0.935 if i % 2 else 0.95
        w = x[pairs + i] - (x[pairs + i] @ x[i]) * x[i]
        x[pairs + i] = near * x[i] + np.sqrt(1 - near**2) * w / np.linalg.norm(w)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        for parts in ("2", "100"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found.append(sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in vector_dedup.near_vectors(df).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] and sum(n for _, n, _ in found[0]) >= 0.98 * 2 * pairs
    assert all((n > 0) == (sum(c == d for _, _, d in found[0]) > 1) for _, n, c in found[0])


def test_meeting_places():
    sizes = [(0, 50), (1, 3), (4, 2), (5, 30), (9, 1)]
    assert vector_dedup.meeting_places(sizes, 24) == [(0, 1), (0, 4), (0, 5), (1, 4), (1, 5), (4, 5), (5, 9)]


def test_one_cosine_decides_at_the_threshold():
    r = np.random.default_rng(13)
    x = r.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(200), np.arange(200)))
    every = vector_dedup.cosines(x[i], x[j]).reshape(200, 200).T
    for threshold in np.sort(every.ravel())[-1000::50]:  # values that occur
        assert (vector_dedup.near(x, x, threshold) == (every >= threshold)).all()

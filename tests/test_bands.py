"""Band joins and box joins on tables whose rows crowd in few groups or cells."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomstone import plans
from loomstone.operators import bands, spatial

PART = "p_partkey long, p_brand string, p_retailprice double"


def most_rows(df) -> int:
    """The largest number of rows that any node of the plan made; df has run."""

    def nodes(p):
        name = p.getClass().getSimpleName()
        kids = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        yield p
        for k in kids:
            yield from nodes(k)

    found = [p.metrics().get("numOutputRows") for p in nodes(df._jdf.queryExecution().executedPlan())]
    return max(m.get().value() for m in found if m.isDefined())


def of_part(spark, tmp_path, rows):
    spark.createDataFrame(rows, PART).write.parquet(str(tmp_path / "part.parquet"))
    return plans.QUERIES["rel_range_join"](spark, str(tmp_path))


def test_a_crowded_band_makes_no_pairs(spark, tmp_path):
    df = of_part(spark, tmp_path, [(i, "b", 100.0 + 15 * (i % 2)) for i in range(6000)])
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == [(i, 3000) for i in range(1, 6000, 2)]
    assert most_rows(df) <= 3 * 6000  # a row is a point and two ends; there are 9,000,000 pairs


def test_range_join_of_odd_rows(spark, tmp_path):
    """Ends of bands, repeated and null keys, null brands and prices, zeros, numbers that are none."""
    rng = random.Random(3)
    odd = [None, math.nan, math.inf, -math.inf, -0.0, 0.0, 10.0, 20.0, -20.0, 1e300, -10.0]
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, "", "x", "y"]), rng.choice([*odd, rng.randrange(0, 400) / 10, rng.randrange(0, 400) / 10])) for _ in range(600)]
    got = [tuple(r) for r in of_part(spark, tmp_path, rows).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(plans.ORACLES["rel_range_join"]).fetchall()
    assert len(want) > 100 and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sums(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(0, 1000, 1, 5).selectExpr("id", "(id * 7) % 1000 AS at", "id % 3 AS n")
        got = bands.running(df, df["n"], "at").orderBy("at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = 0
    for r in got:
        total += r["n"]
        assert (r["running"], r["total"]) == (total, 999)
    assert total == 999 and len(got) == 1000


def test_boxes_of_a_crowded_cell_meet_in_many_tasks(spark, tmp_path):
    """12,000 points in one cell, every place twice."""
    rows = [(i, [0.01 + (i % 6000) * 3e-5, 0.1], 0) for i in range(12_000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = plans.QUERIES["geo_box_join"](spark, str(tmp_path))
    got = [tuple(r) for r in df.withColumn("task", F.spark_partition_id()).collect()]
    assert sorted((a, b) for a, b, _ in got) == [(i, i + 6000) for i in range(6000)]
    assert len({task for *_, task in got}) > 1


@pytest.mark.parametrize("most", [10_000, 3])
@pytest.mark.parametrize("ordered", [True, False])
def test_box_join_in_blocks(spark, monkeypatch, ordered, most):
    """Crowded and empty cells, boxes over many cells, corners on edges, repeated and null ids, boxes that are none."""
    monkeypatch.setattr(spatial, "MOST_PARTITIONS", most)
    rng = random.Random(5)
    form = "id long, min_x double, min_y double, max_x double, max_y double"

    def some(n):
        made = [(1, None, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 0.0, 1.0), (3, 5.0, 5.0, 5.0, 5.0), (None, 0.0, 0.0, 0.5, 0.5)]
        for i in range(n):
            x, y, w, h = (rng.choice([rng.uniform(0, 0.5), rng.uniform(-3, 3), rng.randrange(-4, 4) / 4]) for _ in range(4))
            made.append((rng.choice([i, i, 7, None, 2**60 + i]), x, y, x + abs(w) / 4, y + abs(h) / 4))
        return made

    a, b = some(150), some(110)
    sides = [spark.createDataFrame(rows, form) for rows in (a, b)]
    got = [tuple(r) for r in spatial.box_join(*sides, 0.25, ordered=ordered, blocks=(16, 8)).collect()]

    def meet(p, q):
        return None not in (p[1], q[1]) and p[1] <= p[3] and q[1] <= q[3] and p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]

    want = [(p[0], q[0]) for p in a for q in b if meet(p, q) and (not ordered or (None not in (p[0], q[0]) and p[0] < q[0]))]
    assert len(want) > 100 and sorted(got, key=str) == sorted(want, key=str)


def test_box_join_of_named_boxes_in_blocks(spark):
    df = spark.createDataFrame([(f"n{i}", i % 10 / 10, 0.0, i % 10 / 10, 0.0) for i in range(60)], "id string, min_x double, min_y double, max_x double, max_y double")
    got = spatial.box_join(df, df, 0.5, blocks=(7, 5)).collect()
    assert len(got) == len(set(got)) == 360 and all(int(a[1:]) % 10 == int(b[1:]) % 10 for a, b in got)

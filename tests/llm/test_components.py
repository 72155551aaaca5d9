import uuid

import numpy as np
import pytest

from loomstone.llm.components import ONE_TASK, components


def brute(links):
    name = {x: x for link in links for x in link}
    while True:
        last = dict(name)
        for u, v in links:
            name[u] = name[v] = min(name[u], name[v])
        if name == last:
            return sorted(name.items())


def _links(kind):
    r = np.random.default_rng(31)
    if kind == "chain":
        ids = r.permutation(150)
        return [(int(a) - 50, int(b) - 50) for a, b in zip(ids[:-1], ids[1:], strict=True)]
    if kind == "star":
        return [(1000, i) for i in range(40)] + [(2**62, -(2**62))]
    return [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2)) if a != b]


@pytest.mark.parametrize("one_task", [0, 100, ONE_TASK])
@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_equal_brute_force_at_each_size(spark, kind, one_task):
    links = _links(kind)
    odd = [(v, u) for u, v in links[:5]] + links[:3] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(links + odd, "u long, v long").repartition(5)
    assert sorted(map(tuple, components(df, one_task=one_task).collect())) == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([(4, 4), (None, 1)], "u long, v long")).collect() == []


def test_few_links_cost_the_driver_few_jobs(spark):
    """Rounds over a chain of 149 links took tens of jobs, each with a plan and tasks that the driver holds."""
    df = spark.createDataFrame(_links("chain"), "u long, v long")
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "components")
    try:
        components(df)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup(group)) <= 6

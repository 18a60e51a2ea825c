import random

import pytest

from twinline.llm.components import components


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_matches_union_find(spark, kind):
    rng = random.Random(1)
    if kind == "path":
        order = rng.sample(range(60), 60)
        edges = list(zip(order, order[1:]))
    elif kind == "star":
        edges = [(7, i) for i in range(50) if i != 7] + [(100, 101), (101, 101), (None, 5)]
    else:
        edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_a_round_takes_few_jobs(spark):
    spark.sparkContext.setJobGroup("few", "components")
    try:
        components(spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Seventy-four before the number and digest of a round's edges were taken while they are written.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 60

import random

import pytest

from sievecraft.operators import components as cc


def brute(edges):
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def graph(kind=int):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(140)]
    edges += [(b, a) for a, b in edges[::7]] + edges[::5] + [(2000, 2000)]
    return [(kind(a), kind(b)) for a, b in edges] + [(None, kind(1)), (kind(3000), None)]


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_match_brute_force(spark, one_task, kind):
    """A chain, a hub, random edges, repeats, loops and nulls, by rounds and in one task."""
    edges = graph(kind)
    df = spark.createDataFrame(edges, f"a {'long' if kind is int else 'string'}, b {'long' if kind is int else 'string'}")
    rows = cc.connected_components(df, one_task=one_task).collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows) and got == brute(edges)
    assert cc.connected_components(df.limit(0), one_task=one_task).collect() == []


def test_few_edges_take_few_jobs(spark):
    """Each exchange is a job and a thread that the driver keeps for a minute."""
    df = spark.createDataFrame(graph(), "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few-edges", "")
    try:
        cc.connected_components(df)
        assert len(sc.statusTracker().getJobIdsForGroup("few-edges")) <= 8
    finally:
        sc._jsc.clearJobGroup()


def test_rounds_broadcast_nothing(spark):
    round_ = cc._small_star(cc._large_star(spark.createDataFrame([(2, 1), (3, 2)], "a long, b long")))
    round_.collect()
    assert "Broadcast" not in round_._jdf.queryExecution().executedPlan().toString()

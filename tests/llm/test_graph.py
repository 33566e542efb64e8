import random

from quillon.llm.graph import components, smallest_reached


def brute(edges):
    least = {}
    for a, b in edges:
        least.setdefault(a, a)
        least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def graphs():
    rng = random.Random(6)
    yield [(i, i + 1) for i in range(200)]
    yield [(500, i) for i in range(100)] + [(7, 7)]
    yield [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(160)]


def test_components_equal_brute_force(spark):
    import numpy as np

    for edges in graphs():
        want = brute(edges)
        nodes, roots = smallest_reached(*(np.array(x) for x in zip(*edges)))
        assert dict(zip(nodes.tolist(), roots.tolist())) == want
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if k not in got} <= {a for a, b in edges if a == b}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_need_no_rounds_and_many_the_same_result(spark, monkeypatch):
    from quillon.llm import graph

    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name, old=graph.stored: written.append(name) or old(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(5, 900), (1000, 1001)], "a long, b long").repartition(40)
    once = sorted(map(tuple, components(links).collect()))
    assert len(written) == 1 and once == sorted(brute([(r.a, r.b) for r in links.collect()]).items())
    assert sorted(map(tuple, components(links, task_edges=1).collect())) == once


def test_small_tables_take_few_tasks(spark):
    from quillon.llm.runtime import few

    cores = spark.sparkContext.defaultParallelism
    assert few(spark.range(100).repartition(60), 100).rdd.getNumPartitions() == cores
    assert few(spark.range(100).repartition(60), 20 * 100, 100).rdd.getNumPartitions() == 20

import random

import numpy as np

from quillon.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, node string"


def corpus():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist(), "x") for i in range(900)]
    rows += [(1000 + i, rows[100][1], "x") for i in range(60)]
    centre = rng.normal(size=12)
    rows += [(2000 + i, (centre + 0.05 * rng.normal(size=12)).tolist(), "x") for i in range(120)]
    rows += [(5000, None, "x"), (5050, [0.0] * 12, "x"), (5100, [float("nan")] + [1.0] * 11, "x"), (5150, [None] + [1.0] * 11, "x"), (5200, [float("inf")] * 12, "x"), (5250, [], "x"), (5300, [1.0, 2.0], "x"), (None, rows[0][1], "x"), rows[50]]
    random.Random(1).shuffle(rows)
    return rows


def brute(rows, every, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for i, v in good.items():
        if i % every == 0:
            near = [(-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in good.items() if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in near)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rows = corpus()
    got = N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), shard_nodes=300).collect()
    want = brute(rows, 50, 5)
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(by) == {i for i, x in want.items() if x} and all([x[2] for x in v] == [*range(1, len(v) + 1)] for v in by.values())
    assert all(len(by[i]) == len(want[i]) for i in by)
    hit = sum(len({x[0] for x in by[i]} & {x[0] for x in want[i]}) for i in by) / sum(map(len, by.values()))
    assert hit >= 0.9
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows if v and i is not None and None not in v}
    for i, found in by.items():
        for j, score, _ in found:
            assert abs(score - vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j])) < 1e-12
    assert [x[0] for x in by[1000]] == [100, 1001, 1002, 1003, 1004]
    assert [x[0] for x in by[100]] == [1000, 1001, 1002, 1003, 1004]


def test_few_rows(spark):
    assert N.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.nearest_neighbours(spark.createDataFrame([(50, [1.0, 0.0], "x")], SCHEMA)).count() == 0
    got = N.nearest_neighbours(spark.createDataFrame([(50, [1.0, 0.0], "x"), (3, [1.0, 1.0], "x"), (2, [1.0, 0.0], "x")], SCHEMA)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(50, 1, 2), (50, 2, 3)]


def test_rounds_improve_the_graph():
    x = N.unit(np.random.default_rng(1).normal(size=(600, 16)))
    full = x @ x.T
    np.fill_diagonal(full, -2)
    truth = np.argsort(-full, axis=1)[:, :10]
    graph = N.first_graph(x, 10, 1)
    before = np.mean([len({*a} & {*b}) for a, b in zip(graph, truth)])
    around = [set(a) | {j for j in range(600) if i in graph[j]} for i, a in enumerate(graph)]
    graph = N.nearest_of(x, [np.array(sorted(set().union(around[i], *(around[j] for j in around[i])))) for i in range(600)], 10)
    assert np.mean([len({*a} & {*b}) for a, b in zip(graph, truth)]) > before + 1


def test_scaled_copies_and_extreme_norms(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(100, base.tolist(), "x")] + [(100 + i, (base * i).tolist(), "x") for i in range(1, 21)] + [(300 + i, rng.normal(size=8).tolist(), "x") for i in range(40)]
    rows += [(500, [1e-30] * 8, "x"), (501, [1e30] * 8, "x"), (502, [-1e-40] * 8, "x")]
    got = N.nearest_neighbours(spark.createDataFrame([(i, [float(x) for x in v], n) for i, v, n in rows], "vec_id long, embedding array<double>, node string")).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (100, 500)}
    assert by[100] == [101, 102, 103, 104, 105] and by[500][0] == 501
    assert all(np.isfinite(r.score) for r in got)


def test_groups_without_an_entry_node_are_found(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(120, 24))
    rows = [(i, (centres[i % 120] + 0.3 * rng.normal(size=24)).tolist(), "x") for i in range(4080)]
    got = N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows, 50, 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(by[i] & {x[0] for x in want[i]}) for i in want) >= 0.9 * sum(map(len, want.values()))

"""Block learners against the same learners on one matrix, and the queries' reach."""

import numpy as np
import pytest

from quillon.operators import blocks, learning
from quillon.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(5).normal(size=(90, 6))
    x[50] = x[3]
    y = np.random.default_rng(6).integers(0, 4, 90)
    return x, y, spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "vec_id long, embedding array<double>, label int")


def test_neighbours_of_every_row(table):
    x, y, df = table
    got = {r.vec_id: r.predicted for r in blocks.neighbour_regression(df, "vec_id", "embedding", "label", 5, block=20).collect()}
    assert sorted(got) == list(range(90))
    for i in range(90):
        rest = np.arange(90) != i
        assert got[i] == pytest.approx(learning.neighbour_regression(x[rest], y[rest].astype(float), x[[i]], 5, True)[0])


def test_softmax_over_blocks(table):
    x, _, df = table
    for r in blocks.associative_r2(df, "vec_id", "embedding", 2.0, block=20).collect():
        seen = learning.associative_reconstruction(x, 2.0, r.kernel, r.with_self)
        assert r.r2 == pytest.approx(1 - ((x - seen) ** 2).sum() / ((x - x.mean(0)) ** 2).sum())
    got = {r.place: r.rise for r in blocks.energy_ablation(df, "vec_id", "embedding", 2.0, block=20).collect()}
    assert [got[j] for j in range(6)] == pytest.approx(list(learning.energy_ablation(x, 2.0)))


def test_spectra_of_all_rows(table):
    x, _, df = table
    want = learning.component_r2(x, [1, 3, 6])
    assert blocks.component_r2(df, "embedding", [1, 3, 6]) == pytest.approx(want)
    got = blocks.weight_statistics(df, "vec_id", "embedding")
    assert got == pytest.approx(learning.weight_statistics(x))


def test_queries_read_the_whole_table(spark):
    run = catalogue.queries()
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    assert run["reg07_neighbour_regression"](spark, SF).count() == len(rows)
    want = learning.component_r2(x, [1, 8, 64])
    got = {r.width: r.r2 for r in run["reg09_component_knee"](spark, SF).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    got = {r.statistic: r.value for r in run["nn09_weight_statistics"](spark, SF).collect()}
    assert got["stable_rank"] == pytest.approx(learning.weight_statistics(x)["stable_rank"])
    got = {r.place: r.rise for r in run["red23_energy_ablation"](spark, SF).collect()}
    assert [got[j] for j in range(x.shape[1])] == pytest.approx(list(learning.energy_ablation(x, 4.0)))
    for r in run["red21_associative_reconstruction"](spark, SF).collect():
        seen = learning.associative_reconstruction(x, 8.0, r.kernel, r.with_self)
        assert r.r2 == pytest.approx(1 - ((x - seen) ** 2).sum() / ((x - x.mean(0)) ** 2).sum())
    got = run["nn12_neural_collapse"](spark, SF).first()
    labels = np.array([r["label"] for r in rows])
    means = {c: x[labels == c].mean(0) for c in set(labels)}
    assert got.within == pytest.approx(np.mean([((v - means[c]) ** 2).sum() for v, c in zip(x, labels)]))

"""Redundancy, ridge and readout operators against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import learning, redundancy, scan
from quillon.sources import generators


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 6, 900)
    frame = pd.DataFrame({"a": a, "wave": np.cos(a), "b": rng.normal(size=900), "c": rng.normal(size=900), "g": np.where(np.arange(900) < 300, "x", "y"), "train": np.arange(900) % 3 > 0})
    frame["y"] = 2 * frame["a"] + frame["b"] + 0.1 * rng.normal(size=900)
    return frame, spark.createDataFrame(frame).cache()


def test_forests_and_bins_see_a_wave(table):
    _, df = table
    linear = {r.feature: r.verdict for r in redundancy.redundancy_scores(df, ["a", "wave", "b"]).collect()}
    forest = {r.feature: r.verdict for r in redundancy.redundancy_scores(df, ["a", "wave", "b"], trees=10).collect()}
    assert linear["wave"] == "unique" and forest["wave"] == "redundant" and forest["b"] == "unique"
    r2 = {(r.predictor, r.target): r.r2 for r in redundancy.pairwise_r2(df, ["a", "wave", "b"]).collect()}
    assert len(r2) == 6 and r2["a", "wave"] > 0.95 > 0.5 > r2["wave", "a"] and r2["b", "a"] < 0.1


def test_pairwise_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 1.0), (1.0, 4.0, 2.0)], "k double, v double, w double")
    r2 = {(r.predictor, r.target): r.r2 for r in redundancy.pairwise_r2(df, ["k", "v"]).collect()}
    assert r2 == {("k", "v"): 0.0, ("v", "k"): None}
    assert redundancy.pairwise_r2(df.where("false"), ["k", "v"]).count() == 0


def test_minimal_removals(table):
    _, df = table
    assert redundancy.minimal_removals(df, "y", ["a", "b", "c"], 0.5) == ["a"]
    assert redundancy.minimal_removals(df.withColumn("twin", F.col("a") * 3), "y", ["a", "twin", "b", "c"], 0.5) == ["a", "twin"]
    assert redundancy.minimal_removals(df.withColumn("twin", F.col("a") * 3), "y", ["a", "twin", "b", "c"], 0.5, evaluations=0) == ["a", "twin"]


def test_noise_floor(table):
    _, df = table
    assert 0 <= redundancy.noise_floor(df, "y", ["a", "b"]) < 0.01


def test_literal_coalitions(spark):
    values = spark.createDataFrame([(0, 0.0), (1, 0.2), (2, 0.3), (3, 0.6), (4, 0.1), (5, 0.35), (6, 0.4), (7, 0.9)], "mask long, value double")
    got = {r.feature: r.shapley for r in redundancy.shapley(values, ["a", "b", "c"]).collect()}
    assert sum(got.values()) == pytest.approx(0.9) and got["a"] == pytest.approx(0.2 / 3 + 0.3 / 6 + 0.25 / 6 + 0.5 / 3)


@pytest.mark.parametrize("intercept, ddof", [(True, 0), (False, 1)])
def test_grouped_ridge(table, intercept, ddof):
    frame, df = table
    extra = df.unionByName(df.limit(1).withColumn("g", F.lit("single")).withColumn("a", F.lit(1.0)))
    got = {r.g: r.r2 for r in learning.grouped_ridge(extra, "g", ["a", "b"], ["y", "wave"], "train", 2.0, intercept, ddof).collect()}
    for g, own in frame.groupby("g"):
        t = own["train"].to_numpy()
        x, y = own[["a", "b"]].to_numpy(), own[["y", "wave"]].to_numpy()
        assert got[g] == pytest.approx(scan.ridge_r2(x[t], y[t], x[~t], y[~t], 2.0, intercept, ddof), abs=1e-9)
    assert np.isnan(got["single"])


def test_panel_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 30))
    x[0] = x[1] - x[2]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9, [1.0] * 30)], "id long, v array<double>")
    partners = spark.createDataFrame([(0, 1), (0, 2), (3, 1), (9, 1)], "key long, partner long")
    got = {r.key: r.r2 for r in learning.panel_ridge(df, partners, "id", "v", 0.5).collect()}
    m = x - x.mean(1, keepdims=True)
    for key, own in {0: [1, 2], 3: [1]}.items():
        a, y = m[own].T, m[key]
        rest = y - a @ np.linalg.solve(a.T @ a + 0.5 * np.eye(len(own)), a.T @ y)
        assert got[key] == pytest.approx(1 - (rest**2).sum() / (y**2).sum())
    assert got[9] == 0.0 and got[0] > 0.95


def test_name_roots(spark):
    rows = spark.createDataFrame([("AVAL", "AVA"), ("AVA", "AVA"), ("ASHL2", "ASH"), ("ASHL", "ASH"), ("XYZ", "XYZ"), ("QQ12", "QQ12"), ("", ""), (None, None)], "name string, root string")
    got = rows.select("root", scalar.name_root(F.col("name"), ["AVA", "ASH"]).alias("got")).collect()
    assert all(r.root == r.got for r in got)


def test_readouts(spark):
    config = scan.ScanConfig(degree=2, difference=False, members=2)
    rows = scan.states(generators.coupled_system(spark, 1, 300, 4, 2), config).cache()
    coded = scan.codes(rows, config)
    got = {r.channel: r for r in scan.readouts(rows, coded, config).collect()}
    plain = {r.channel: r for r in scan.excesses(rows, coded, config).collect()}
    frame = rows.toPandas().sort_values("t")
    assert set(got) == set(plain) == set(frame["channel"])
    for channel, r in got.items():
        assert r.base == pytest.approx(plain[channel].self_r2) and r.affine == pytest.approx(plain[channel].excess)
        mine = frame[frame["channel"] == channel]
        t, y = mine["train"].to_numpy(), mine["target"].to_numpy()
        feats = [scan.products(np.stack(frame[frame["channel"] == c]["own"]), 2) for c in [channel, *sorted(set(got) - {channel})]]
        x = np.hstack(feats)
        assert r.oracle + r.base == pytest.approx(scan.ridge_r2(x[t], y[t], x[~t], y[~t], 1.0))
        if r.readout_share is not None:
            assert r.readout_share + r.compression_share == pytest.approx(1)
    with pytest.raises(ValueError):
        scan.readouts(rows.select(F.concat("channel", F.col("t").cast("string")).alias("channel"), "t", "train", "own", "target"), coded, config)


def test_forests_take_tasks_by_rows(spark):
    from quillon.operators import redundancy

    one = spark.range(3 * redundancy.FOREST_ROWS + 5).coalesce(1)
    assert redundancy.forest_rows(one).rdd.getNumPartitions() == 4 and redundancy.forest_rows(one).count() == one.count()
    assert redundancy.forest_rows(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 1
    x = spark.range(2000).selectExpr("cast(id % 40 AS double) AS x", "cast(id % 7 AS double) AS z", "cos(id % 40 / 8) AS y")
    assert redundancy.forest_r2(x, "y", ["x", "z"], trees=5) > 0.9


def test_a_permutation_scores_the_rows_as_they_are_once(spark):
    from pyspark.ml.functions import vector_to_array

    from quillon.operators import learning

    class Model:
        calls = 0

        def transform(self, df):
            Model.calls += 1
            return df.withColumn("prediction", vector_to_array("_x")[0])

    rows = spark.range(400).selectExpr("cast(id % 2 AS double) AS a", "cast(id % 5 AS double) AS b", "cast(id % 3 AS double) AS c", "cast(id % 2 AS double) AS _y")
    costs = learning.permutation_costs(rows, Model(), ["a", "b", "c"], 0)
    assert Model.calls == 4 and [n for _, n, _ in costs] == ["a", "b", "c"]
    assert costs[0][2] > 0.2 and costs[1][2] == costs[2][2] == 0

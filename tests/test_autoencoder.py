"""The distributed ensemble against plain numpy, naive recreation, and the controls of the scan."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import autoencoder as A
from quillon.operators import scan
from quillon.sources import generators

WIDTH = 3


def table(spark, n, channels, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 2))
    x = (base @ rng.normal(size=(2, channels * WIDTH)) + 0.1 * rng.normal(size=(n, channels * WIDTH))).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "x": x.astype(np.float64).tolist()}), "t long, x array<double>")
    return x, frame.select("t", F.col("x").cast("array<float>").alias("x"))


def loss(p, x, hidden_filled, hidden, binary):
    seen = hidden_filled
    units = np.tanh(seen @ p["w1"] + p["b1"])
    code = units @ p["w2"] + p["b2"]
    code = np.where(code >= 0, 1, -1) if binary else code
    out = np.tanh(code @ p["w3"] + p["b3"]) @ p["w4"] + p["b4"]
    return float((((out - x) ** 2) * hidden).sum())


@pytest.mark.parametrize("fill", ["zero", "uniform"])
def test_gradients_equal_differences(fill):
    how = A.Training(code=3, fill=fill)
    x = np.random.default_rng(1).normal(size=(20, 12)).astype(np.float64)
    t = np.arange(20)
    p = {k: v.astype(np.float64) for k, v in A.first_parameters(12, how, 0).items()}
    seen, hidden = A.corrupted(x, t, WIDTH, how, 0, 5)
    assert 0.1 < hidden.mean() < 0.45 and (hidden.reshape(20, 4, WIDTH).all(2) == hidden.reshape(20, 4, WIDTH).any(2)).all()
    g, error, n = A.gradients(x, t, WIDTH, p, how, 0, 5)
    assert error == pytest.approx(loss(p, x, seen, hidden, False)) and n == hidden.sum()
    rng = np.random.default_rng(2)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            moved = {s: {q: v.copy() for q, v in p.items()} for s in (1, -1)}
            for s in moved:
                moved[s][k][at] += s * 1e-5
            slope = (loss(moved[1], x, seen, hidden, False) - loss(moved[-1], x, seen, hidden, False)) / 2e-5
            assert g[k][at] == pytest.approx(slope, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("binary", [False, True])
def test_training_does_not_depend_on_partitions(spark, binary, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 2)  # several column blocks
    how = A.Training(code=3, members=2, steps=6, binary=binary)
    x, frame = table(spark, 90, 5)
    plain = []
    for m in range(2):
        state = A.Adam(A.first_parameters(15, how, m), how.rate)
        for step in range(how.steps):
            g, _, n = A.gradients(x, np.arange(90), WIDTH, state.p, how, m, step)
            state.update({k: (v / n).astype(np.float32) for k, v in g.items()})
        plain.append(state.p)
    for parts in (1, 7):
        model = A.train(frame.repartition(parts), 15, WIDTH, how)
        for got, want in zip(model, plain):
            for k in want:
                assert np.allclose(got[k], want[k], atol=2e-3), k
        coded = A.encoded(frame, model, WIDTH, how).toPandas().sort_values("t")
        codes = np.stack(coded["code"])
        want = np.concatenate([A.encode(x, p, binary)[2] for p in model], axis=1)
        assert np.allclose(codes, want, atol=1e-4) and codes.shape == (90, 6)
        assert not binary or set(np.unique(codes)) <= {-1.0, 1.0}


def test_loss_falls_and_members_differ(spark):
    how = A.Training(code=3, members=2, steps=40)
    x, frame = table(spark, 200, 6)
    model = A.train(frame, 18, WIDTH, how)
    for m, p in enumerate(model):
        before, after = (A.gradients(x, np.arange(200), WIDTH, q, how, m, 999)[1] for q in (A.first_parameters(18, how, m), p))
        assert after < 0.5 * before
    assert not np.allclose(model[0]["w1"], model[1]["w1"])


@pytest.mark.parametrize("fill", ["zero", "uniform"])
def test_membership_equals_naive_recreation(spark, fill):
    how = A.Training(code=3, members=2, steps=25, fill=fill)
    x, frame = table(spark, 120, 4)
    lone = x.copy()
    lone[:, 9:] = np.random.default_rng(9).normal(size=(120, 3))  # the last channel has nothing to do with the others
    frame = spark.createDataFrame(pd.DataFrame({"t": np.arange(120), "x": lone.astype(np.float64).tolist()}), "t long, x array<double>")
    model = A.train(frame, 12, WIDTH, how)
    draws = 3 if fill == "uniform" else 1
    got = {r.channel: r for r in A.memberships(frame, list("abcd"), model, WIDTH, how, draws).collect()}
    for c, name in enumerate("abcd"):
        each = []
        for m, p in enumerate(model):
            r2 = []
            for d in range(draws):
                seen = lone.copy()
                seen[:, 3 * c : 3 * c + 3] = (4 * A.uniforms(np.arange(120), 12, 0, m, d, 2) - 2)[:, 3 * c : 3 * c + 3] if fill == "uniform" else 0
                own = lone[:, 3 * c : 3 * c + 3]
                out = (np.tanh(A.encode(seen, p, False)[2] @ p["w3"] + p["b3"]) @ p["w4"] + p["b4"])[:, 3 * c : 3 * c + 3]
                r2.append(max(0, 1 - ((out - own) ** 2).mean() / (own.astype(float).var() + 1e-12)))
            each.append(np.mean(r2))
        assert got[name].membership == pytest.approx(np.mean(each), abs=2e-3) and got[name].spread == pytest.approx(np.std(each), abs=2e-3)
    assert got["d"].membership < 0.2 < min(got[c].membership for c in "abc")


def test_binary_scan_and_odd_channels(spark):
    made = generators.coupled_system(spark, 0, 700, 8, 3)
    odd = made.select("t", "channel", "value").unionByName(spark.createDataFrame([(t, c, v) for t in range(700) for c, v in (("flat", 1.0), ("none", None))], "t long, channel string, value double"))
    config = scan.ScanConfig(degree=2, ghosts=6, difference=False, steps=20, binary=True)
    result, ghosts, gates = scan.scan(odd, config)
    out = result.toPandas()
    assert len(out) == 8 and out["excess"].notna().all() and ghosts.count() == 6 and gates.count() == 1
    rows = scan.states(made, config)
    times = rows.groupBy("train").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()
    ends = {r.train: (r.a, r.b) for r in times}
    assert ends[False][0] - ends[True][1] >= 0.2 * 700  # the gap


def test_ten_thousand_channels(spark):
    """Nothing of channels squared: 30,000 inputs train in a worker of a few hundred MB."""
    n, channels = 48, 10_000
    frame = spark.range(0, n, 1, 4).select(F.col("id").alias("t"), F.transform(F.sequence(F.lit(1), F.lit(channels * WIDTH)), lambda i: F.sin(i * (F.col("id") + 1) / 7).cast("float")).alias("x"))
    how = A.Training(code=8, members=1, steps=2)
    model = A.train(frame, channels * WIDTH, WIDTH, how)
    assert model[0]["w1"].shape == (30_000, 64) and np.isfinite(model[0]["w1"]).all()
    assert not np.allclose(model[0]["w1"], A.first_parameters(30_000, how, 0)["w1"])
    assert A.encoded(frame, model, WIDTH, replace(how)).count() == n

"""Dependence tests over whole samples: blocked kernels equal dense ones, and all verdicts of the pair orientation."""

import numpy as np
import pandas as pd
import pytest

from quillon.functions import stats
from quillon.operators import blocks, causal


def dense(x, y):
    def kernel(v):
        d = (v[:, None] - v[None]) ** 2
        k = np.exp(-d / (np.median(d[d > 0]) if (d > 0).any() else 1.0))
        return k - k.mean(0) - k.mean(1, keepdims=True) + k.mean()

    return (kernel(x) * kernel(y)).sum() / (len(x) - 1) ** 2


@pytest.mark.parametrize("n", [2, 3, 7, 50, 1300])
def test_blocked_kernels_equal_dense_ones(n):
    rng = np.random.default_rng(n)
    x, y = np.round(rng.normal(size=n), 1), rng.normal(size=n) ** 2
    assert stats.hsic(x, y) == pytest.approx(dense(x, y), rel=1e-9, abs=1e-14)


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 2.0], [0.0, 0.0, 3.0], [1.0, 2.0, 4.0], [1e-9, 0.0, 1e9]])
def test_median_gap(values):
    v = np.array(values)
    d = (v[:, None] - v[None]) ** 2
    assert stats.median_gap(v) == pytest.approx(np.median(d[d > 0]) if (d > 0).any() else 1.0, rel=1e-12)


def test_grouped_hsic_reads_all_rows(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": ["a"] * 400 + ["b"] * 90 + ["c"] + [None] * 5, "x": np.round(rng.normal(size=496), 1)})
    frame["y"] = np.round(frame["x"] ** 2 + rng.normal(size=496), 1)
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("a", None, 1.0)], "g string, x double, y double"))
    got = {r.g: (r.n, r.hsic) for r in blocks.grouped_hsic(df, "g", "x", "y", block=32).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == (1, 0.0)
    for g in "ab":
        own = frame[frame["g"] == g]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(dense(own["x"].to_numpy(), own["y"].to_numpy()), rel=1e-9)


def test_grouped_hsic_of_an_empty_table(spark):
    assert blocks.grouped_hsic(spark.createDataFrame([], "g string, x double, y double"), "g", "x", "y").count() == 0


def test_every_row_and_every_kind_of_verdict(spark):
    rng = np.random.default_rng(0)
    u, e, z = rng.uniform(-1, 1, 900), rng.uniform(-1, 1, 900), rng.normal(size=900)
    cubic, line = u + 2 * u**3 + 0.4 * e, z + 0.5 * rng.normal(size=900)
    pairs = {
        "forward": (u, cubic, causal.FORWARD),
        "backward": (cubic, u, causal.BACKWARD),
        "apart": (u, z, causal.INDEPENDENT),
        "wave": (u, np.cos(2 * np.pi * u), causal.EXACT_FORWARD),
        "back wave": (np.cos(2 * np.pi * u), u, causal.EXACT_BACKWARD),
        "bijection": (u, u**3 + u, causal.BIJECTION),
        "gaussian": (z, line, causal.UNDECIDED),
        "constant": (np.ones(900), z, causal.INDEPENDENT),
        "short": (u[:3], u[:3], causal.INDEPENDENT),
    }
    frame = pd.concat([pd.DataFrame({"pair": k, "x": x, "y": y}) for k, (x, y, _) in pairs.items()] + [pd.DataFrame({"pair": ["apart"], "x": [np.nan], "y": [1.0]})])
    got = {r.pair: r.verdict for r in causal.anm_orient(spark.createDataFrame(frame), draws=60).collect()}
    assert got == {k: v for k, (_, _, v) in pairs.items()}

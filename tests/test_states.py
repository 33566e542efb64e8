"""The exact neighbour join and the joint pair calibration against brute force."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from quillon.operators import calibration, knn, manifold

SCHEMA = "system string, t long, state array<double>"


def brute(rows, k, radius):
    """Each (system, t)'s k nearest (distance, time) among rows further than radius in time."""
    out = {}
    for s, t, x in rows:
        near = sorted((round(math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), 9), u) for r, u, y in rows if r == s and abs(u - t) > radius)
        out[s, t] = near[:k]
    return {key: near for key, near in out.items() if near}


def got(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r.system, r.t), []).append((r.rank, r.distance, r.neighbour))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {key: [(d, u) for _, d, u in sorted(v)] for key, v in out.items()}


def series(n, seed):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=(n, 3)), axis=0).round(2)
    return [("walk", t, x[t].tolist()) for t in range(n)]


@pytest.mark.parametrize("radius", [0, 5])
def test_many_cells(spark, radius):
    rows = series(400, 1) + [("clusters", t, [float(t % 4) * 100 + (t * 7919 % 13) / 10, 0.0]) for t in range(300)] + [("small", t, [float(t)]) for t in range(3)] + [("one", 5, [1.0])]
    want = brute(rows, 4, radius)
    assert got(knn.knn_join(spark.createDataFrame(rows, SCHEMA), 4, radius, cell=30)) == want


def test_repeated_states_and_ties(spark):
    rows = [("hot", t, [1.0, 2.0]) for t in range(250)] + [("hot", 300 + t, [float(t % 5), 2.0]) for t in range(60)]
    assert got(knn.knn_join(spark.createDataFrame(rows, SCHEMA), 3, 2, cell=20)) == brute(rows, 3, 2)


def test_odd_points(spark):
    rows = series(40, 2)
    odd = [("walk", 100, None), ("walk", 101, [1.0, None, 2.0]), ("walk", 102, [float("nan"), 0.0, 0.0]), ("walk", 103, [float("inf"), 0.0, 0.0]), (None, 1, [0.0, 0.0, 0.0]), ("walk", None, [0.0, 0.0, 0.0])]
    assert got(knn.knn_join(spark.createDataFrame(rows + odd, SCHEMA), 4, 1, cell=10)) == brute(rows, 4, 1)
    assert knn.knn_join(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_cross_map_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = [0.4], [0.2]
    for _ in range(299):
        a, b = x[-1], y[-1]
        x.append(a * (3.8 - 3.8 * a))
        y.append(b * (3.5 - 3.5 * b - 0.1 * a))
    noise = rng.normal(size=300)
    rows = [("coupled", t, x[t], y[t]) for t in range(300)] + [("flat", t, 1.0, float(noise[t])) for t in range(300)]
    out = {(r.system, r.cause): r for r in knn.cross_map_skill(spark.createDataFrame(rows, "system string, t long, x double, y double"), 3, radius=2).collect()}
    for cause, own, other in (("x", y, x), ("y", x, y)):
        assert out["coupled", cause].rho == pytest.approx(manifold.cross_map(np.array(own), np.array(other), 3, 1, 2), abs=1e-6)
    assert out["coupled", "x"].rho > out["coupled", "y"].rho and out["flat", "x"].rho is None


def weights(key, b):
    u = int(hashlib.md5(f"{b}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    return 1 if b == 0 else sum(u > p for p in calibration.POISSON)


@pytest.mark.parametrize("statistic", ["correlation", "proximity"])
def test_joint_histogram_equals_brute_force(spark, statistic):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(90, 2))
    first, second = base @ rng.normal(size=(2, 6)) + rng.normal(size=(90, 6)), base @ rng.normal(size=(2, 5)) + 1
    first[7] = 3.0  # constant: its correlations are 0
    second[8] = 0.0
    rows = [(i, first[i].tolist(), second[i].tolist(), "x") for i in range(90)]
    odd = [(None, rows[0][1], rows[0][2], "x"), (900, None, rows[0][2], "x"), (901, rows[0][1], [1.0, None, 1.0, 1.0, 1.0], "x")]
    frame = spark.createDataFrame(rows + odd, "id long, a array<double>, b array<double>, pairs string")
    made = calibration.joint_histogram(frame, "id", "a", "b", 3, 10, 16, statistic, block=16)
    want = {}
    for i in range(90):
        for j in range(i + 1, 90):
            r = 0.0 if np.ptp(first[i]) == 0 or np.ptp(first[j]) == 0 else np.corrcoef(first[i], first[j])[0, 1]
            c, d = second[i], second[j]
            if statistic == "proximity":
                e = 2 * c @ d / (c @ c + d @ d + 1e-12)
            else:
                e = 0.0 if np.ptp(c) == 0 or np.ptp(d) == 0 else np.corrcoef(c, d)[0, 1]
            cell = int(calibration.places(np.round(min(r * r, 0.999999), 9), 0, 0.1, 10)), int(calibration.places(np.round(e, 9), -1.024, 0.128, 16))
            for b in range(4):
                want[b, *cell] = want.get((b, *cell), 0) + weights(i, b) * weights(j, b)
    assert {(r.replicate, r.r_bin, r.e_bin): r.pairs for r in made.collect()} == {k: v for k, v in want.items() if v}
    curve = calibration.curves(made, 0.2, 16).toPandas()
    for (b, r), s in pd.DataFrame([(*k, v) for k, v in want.items() if v], columns=["b", "r", "e", "n"]).groupby(["b", "r"]):
        row = curve[(curve["replicate"] == b) & (curve["r_bin"] == r)].iloc[0]
        middle = -1.024 + 0.064 + 0.128 * s["e"]
        assert row["pairs"] == s["n"].sum() and row["p_equiv"] == pytest.approx(s["n"][middle > 0.2].sum() / s["n"].sum())
        assert row["mean_e"] == pytest.approx((middle * s["n"]).sum() / s["n"].sum())


def test_multiplicities_are_poisson_and_empty_tables(spark):
    from pyspark.sql import functions as F

    drawn = spark.range(20_000).select(calibration.multiplicity(F.col("id"), 1).alias("w")).toPandas()["w"]
    assert abs(drawn.mean() - 1) < 0.03 and abs(drawn.var() - 1) < 0.06 and drawn.max() <= 8
    empty = spark.createDataFrame([], "id long, a array<double>, b array<double>")
    assert calibration.joint_histogram(empty, "id", "a", "b", 2).count() == 0

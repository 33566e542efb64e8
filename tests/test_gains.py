"""The gain matrix against refits."""

import numpy as np
import pandas as pd
import pytest

from quillon.operators import gains, scan


def refits(rows, alpha, seed):
    names = sorted(rows["channel"].unique())
    by = {c: rows[rows["channel"] == c].sort_values("t") for c in names}
    z = {c: np.stack(f["own"]) for c, f in by.items()}
    train = by[names[0]]["train"].to_numpy()
    n, out = len(train), {}

    def r2(x, y):
        w = np.linalg.solve(x[train].T @ x[train] + alpha * np.eye(x.shape[1]), x[train].T @ y[train])
        return max(0.0, 1 - ((x[~train] @ w - y[~train]) ** 2).mean() / (y[~train].var() + 1e-12))

    for u in names:
        donor, shift = gains.donor_of(u, names, n, seed)
        ghost, others = np.roll(z[donor], shift, axis=0), [c for c in names if c != u]
        base = r2(np.hstack([z[c] for c in others] + [ghost]), z[u])
        lone = base - r2(np.hstack([z[c] for c in others]), z[u])
        for v in others:
            out[u, v] = base - r2(np.hstack([z[c] for c in others if c != v] + [ghost]), z[u]), base, lone
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_gains_equal_refits(spark, block, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x[1:, 0] += 0.8 * x[:-1, 3]
    x[:, 4] = x[:, 1] + 0.1 * rng.normal(size=300)
    frame = pd.DataFrame([(f"c{j}", t, float(x[t, j])) for j in range(5) for t in range(300)], columns=["channel", "t", "value"])
    rows = scan.states(spark.createDataFrame(frame), scan.ScanConfig(difference=False))
    held = gains.summed_grams
    monkeypatch.setattr(gains, "summed_grams", lambda wide, size: held(wide, size, block))
    got = {(r.target, r.source): (r.gain, r.full_r2, r.ghost_gain) for r in gains.gain_matrix(rows, 1.0, 3).collect()}
    want = refits(rows.toPandas(), 1.0, 3)
    assert set(got) == set(want) and len(got) == 20
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9), key
    assert max(got, key=lambda k: got[k][0]) in {("c4", "c1"), ("c1", "c4")}


def test_channels_that_lack_times_and_too_few(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame([(f"c{j}", t, float(rng.normal())) for j in range(3) for t in range(100) if (j, t % 10) != (1, 3)], columns=["channel", "t", "value"])
    rows = scan.states(spark.createDataFrame(frame), scan.ScanConfig(difference=False))
    assert gains.gain_matrix(rows).count() == 6
    with pytest.raises(ValueError):
        gains.gain_matrix(rows.where("channel <> 'c0'"))

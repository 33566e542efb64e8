"""What block pairs and kernels cost as tables grow, and that rough products leave results exact."""

import numpy as np
import pytest

from quillon.functions import stats
from quillon.operators import blocks, calibration, pairs


def test_blocks_do_not_grow_with_the_table():
    assert pairs.block_count(100) == 1
    assert pairs.block_count(20_000) <= 2 * pairs.SIDE and pairs.block_count(900_000) <= 2 * pairs.SIDE
    assert 10**8 / pairs.block_count(10**8) <= pairs.LARGEST


def test_nearest_is_exact_under_ties_and_copies():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (700, 4)).astype(float), rng.integers(0, 3, (2600, 4)).astype(float)
    b[2000:] = b[:600] + 1e-7 * rng.normal(size=(600, 4))  # nearer than single precision tells
    exact = lambda i, j: np.round(((a[i] - b[j]) ** 2).sum(1), 15)
    rough, slack = blocks.rough_gaps(a, b)
    row, column, far = pairs.nearest(len(a), len(b), rough, exact, 5, slack)
    for i in (0, 3, 511, 512, 699):
        d = exact(np.full(len(b), i), np.arange(len(b)))
        want = np.lexsort((np.arange(len(b)), d))[:5]
        assert column[row == i].tolist() == want.tolist() and far[row == i].tolist() == d[want].tolist()


def test_equal_values_are_one_weighted_value():
    v = np.random.default_rng(1).integers(0, 40, 500).astype(float)
    value, count = np.unique(v, return_counts=True)
    assert stats.median_gap(value, count) == stats.median_gap(v)


@pytest.mark.parametrize("reach", [0.0, 0.3, 4.0, 60.0])
def test_series_of_a_kernel(reach):
    u, terms = np.linspace(-1, 1, 301), blocks.series_terms(reach)
    assert terms <= blocks.MOST_TERMS
    p = blocks.polynomials(u, terms)
    assert np.abs(p @ blocks.kernel_series(reach, terms) @ p.T - np.exp(-reach * (u[:, None] - u[None]) ** 2)).max() < 1e-12


def test_a_large_group_takes_no_pairs(spark):
    """Half a million different rows; all pairs of them would be 10**11 kernels."""
    frame = spark.range(500_000).selectExpr("'a' AS g", "id * 0.001 AS x", "cos(id * 0.001) * 100 + id % 7 AS y")
    got = blocks.grouped_hsic(frame, "g", "x", "y").first()
    assert got.n == 500_000 and 0 < got.hsic < 1


def test_ablation_by_series_and_by_exponentials():
    assert blocks.powers_needed(1.3) < 40
    for reach in (0.1, 1.3, blocks.SERIES):
        terms, z = blocks.powers_needed(reach), np.linspace(-reach, reach, 101)
        total, term = np.ones_like(z), np.ones_like(z)
        for m in range(1, terms):
            term = term * z / m
            total += term
        assert np.abs(total / np.exp(z) - 1).max() < 1e-13


@pytest.mark.parametrize("statistic", ["correlation", "proximity"])
def test_joint_histogram_of_tiles(spark, statistic):
    """Copies, constant vectors and an odd tile at each end; three replicates' sums over a tile fit into one number."""
    assert 53 // int(1.25 * calibration.ROWS * calibration.COLUMNS).bit_length() >= 3
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2 * calibration.ROWS + 5, 12))
    x[300:330], x[7], x[401, :6] = x[:30], 0, 2.0
    df = spark.createDataFrame([(i, v[:6].tolist(), v[6:].tolist()) for i, v in enumerate(x)], "k long, a array<double>, b array<double>")
    got = {(r.replicate, r.r_bin, r.e_bin): r.pairs for r in calibration.joint_histogram(df, "k", "a", "b", 4, statistic=statistic).collect()}
    w = np.array([r[1:] for r in sorted(df.select("k", *(calibration.multiplicity(df.k, b).alias(f"w{b}") for b in range(5))).collect())])
    i, j = np.triu_indices(len(x), 1)
    a, b = calibration._centred(x[:, :6]), x[:, 6:] if statistic == "proximity" else calibration._centred(x[:, 6:])
    r2, dot = np.round(np.minimum((a[i] * a[j]).sum(1) ** 2, 0.999999), 9), (b[i] * b[j]).sum(1)
    e = np.round(calibration._proximity(dot, (b[i] ** 2).sum(1), (b[j] ** 2).sum(1)) if statistic == "proximity" else dot, 9)
    cell = calibration.places(r2, 0.0, 0.05, 20) * 64 + calibration.places(e, -1.024, 0.032, 64)
    want = {}
    for r in range(5):
        sums = np.bincount(cell, weights=w[i, r] * w[j, r])
        want |= {(r, int(c) // 64, int(c) % 64): sums[c] for c in np.flatnonzero(sums)}
    assert got == want

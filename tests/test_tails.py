"""Exact tails and signed ranks at all sizes."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import stats


def test_tails_equal_whole_numbers(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        n = int(rng.integers(1, 400))
        m, d = int(rng.integers(0, n + 1)), int(rng.integers(0, n + 1))
        rows.append((int(rng.integers(0, min(m, d) + 2)), n, m, d))
    frame = spark.createDataFrame(rows, "k long, n long, m long, d long")
    for r in frame.select("*", stats.hypergeometric_sf("k", "n", "m", "d").alias("p"), stats.sign_test("k", "n").alias("s")).collect():
        want = sum(math.comb(r["m"], i) * math.comb(r["n"] - r["m"], r["d"] - i) for i in range(max(r["k"], r["d"] - r["n"] + r["m"], 0), min(r["m"], r["d"]) + 1)) / math.comb(r["n"], r["d"])
        assert r["p"] == pytest.approx(want, rel=1e-11)
        assert r["s"] == pytest.approx(sum(math.comb(r["n"], i) for i in range(r["k"], r["n"] + 1)) / 2 ** r["n"], rel=1e-11)


def test_tails_of_large_numbers(spark):
    began = time.time()
    frame = spark.createDataFrame([(500_600, 1_000_000), (5_000_003_000, 10_000_000_000), (10**10, 10**10), (0, 10**10)], "k long, n long")
    got = [r[0] for r in frame.select(stats.sign_test("k", "n")).collect()]
    normal = lambda k, n: 0.5 * math.erfc((k - 0.5 - n / 2) / math.sqrt(n / 4) / math.sqrt(2))
    assert got[:2] == pytest.approx([normal(500_600, 10**6), normal(5_000_003_000, 10**10)], rel=1e-5) and got[2:] == [0.0, 1.0]
    rare = spark.createDataFrame([(3, 10**12, 1_000_000, 1_000_000)], "k long, n long, m long, d long").select(stats.hypergeometric_sf("k", "n", "m", "d")).first()[0]
    assert rare == pytest.approx(1 - math.exp(-1) * 2.5, rel=1e-4)  # nearly Poisson of mean 1
    assert time.time() - began < 30


@pytest.mark.parametrize("exact", [2000, 3])
def test_signed_ranks_of_groups(spark, exact):
    rng = np.random.default_rng(2)
    groups = {"ties": rng.integers(-3, 5, 60).astype(float), "plain": rng.normal(0.3, 1, 45), "one": np.array([2.0]), "zeros": np.zeros(4), "all alike": np.array([1.0, 1.0, -1.0, 1.0, 1.0])}
    rows = [(g, float(x)) for g, d in groups.items() for x in d] + [("ties", None), (None, 1.0), ("plain", float("nan"))]
    got = {r["g"]: r for r in stats.signed_rank(spark.createDataFrame(rows, "g string, d double"), "g", "d", exact).collect()}
    assert set(got) == set(groups)
    for g, d in groups.items():
        assert got[g]["n"] == (d != 0).sum()
        assert got[g]["p"] == pytest.approx(stats.signed_rank_p(d), abs=1e-12 if exact > len(d) else 0.03)


def test_signed_ranks_beyond_the_enumeration(spark):
    d = np.random.default_rng(3).normal(0.03, 1, 5000).round(2)
    got = stats.signed_rank(spark.createDataFrame([("x", float(v)) for v in d], "g string, d double"), "g", "d").first()
    assert got["p"] == pytest.approx(stats.signed_rank_p(d), abs=1e-9)
    assert stats.signed_rank(spark.createDataFrame([], "g string, d double"), "g", "d").count() == 0

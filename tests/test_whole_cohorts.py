"""Tests over whole cohorts against enumeration, and the queries' reach."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_rank_sums_with_ties(spark):
    d = [1.0, -2.0, 2.0, 3.0, 3.0, 0.0, -1.0, 5.0, 6.5]
    x = np.array([v for v in d if v])
    ranks = np.array([(abs(x) < v).sum() + ((abs(x) == v).sum() + 1) / 2 for v in abs(x)])
    sums = np.array([(ranks * c).sum() for c in itertools.product((0, 1), repeat=len(x))])
    w = ranks[x > 0].sum()
    many = [float(v) for v in np.random.default_rng(0).normal(0.1, 1, 800)]
    got = [r[0] for r in spark.createDataFrame([(d,), (many,)], "d array<double>").select(stats.wilcoxon_exact("d")).collect()]
    assert got[0] == pytest.approx(min(1, 2 * min((sums <= w).mean(), (sums >= w).mean()))) and 0 < got[1] < 1


def test_every_user_enters_the_test(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    v = events.groupBy("user_id").pivot("event_type").agg(F.avg("value")).toPandas()
    for r in catalogue.queries()["sta18_wilcoxon"](spark, SF).collect():
        d = (v[r.event_type] - v["view"]).dropna().tolist()
        want = spark.createDataFrame([(d,)], "d array<double>").select(stats.wilcoxon_exact("d")).first()[0]
        assert r.p == pytest.approx(want)


def test_cohort_equals_enumeration(spark):
    rng = np.random.default_rng(3)
    sums, counts = rng.normal(size=(7, 3)) * 9, rng.integers(1, 5, (7, 3)).astype(float)
    gap = lambda c: abs(sums[list(c)].sum(0) / counts[list(c)].sum(0) - (sums.sum(0) - sums[list(c)].sum(0)) / (counts.sum(0) - counts[list(c)].sum(0)))
    every = [gap(c).max() for c in itertools.combinations(range(7), 3)]
    want = [np.mean([g >= s - 1e-12 for g in every]) for s in gap((0, 1, 2))]
    assert stats.cohort_p(spark, sums, counts, 3) == pytest.approx(want)


def test_cohort_has_all_nations(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(stats, "cohort_p", lambda spark, sums, counts, size: seen.update(n=counts.sum(), size=size) or np.zeros(counts.shape[1]))
    catalogue.queries()["sta20_cohort_permutation"](spark, SF).collect()
    assert seen == {"n": spark.read.parquet(f"{SF}/customer.parquet").count(), "size": 12}


def test_large_samples_agree_with_the_enumeration(monkeypatch):
    d = [[float(v) for v in np.random.default_rng(k).normal(0.04, 1, 700).round(k + 1)] for k in range(3)]
    exact = [float(stats.wilcoxon_exact.func([x])[0]) for x in d]
    monkeypatch.setattr(stats, "EXACT_DIFFERENCES", 10)
    assert [float(stats.wilcoxon_exact.func([x])[0]) for x in d] == pytest.approx(exact, abs=1e-3)

"""Cuts by hash, group constants without windows, and running counts over many parts, against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import ranks, stats
from quillon.operators import relational as R


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("take", [lambda n: 0, lambda n: 1, lambda n: n // 2, lambda n: n, lambda n: n + 3, lambda n: -2])
def test_first_by_hash(spark, digits, take):
    rng = random.Random(digits)
    rows = [(i, rng.choice([None, "hot", "hot", "a", "b"])) for i in range(300)] + [(999, "single")]
    wanted = {0: F.lit(0), 1: F.lit(1), 150: F.floor(F.col("n") / 2), 300: F.col("n"), 303: F.col("n") + 3, -2: F.lit(-2)}[take(300)]
    frame = spark.createDataFrame(rows, "i int, g string")
    got = ranks.first_by_hash(frame, ["g"], F.md5(F.col("i").cast("string").cast("binary")), "i", wanted, digits=digits).collect()
    groups = defaultdict(list)
    for i, g in rows:
        groups[g].append((md5(str(i)), i))
    want = {i: at < take(len(members)) for members in groups.values() for at, (_, i) in enumerate(sorted(members))}
    assert len(got) == len(rows) and {r.i: r.chosen for r in got} == want


def test_first_by_hash_of_ties_and_nulls(spark):
    frame = spark.createDataFrame([(i, "aa") for i in range(5)] + [(9, None)], "i int, h string")
    got = ranks.first_by_hash(frame, [], F.col("h"), "i", F.lit(3)).collect()
    assert {r.i for r in got if r.chosen} == {9, 0, 1} and len(got) == 6
    assert ranks.first_by_hash(frame.limit(0), [], F.col("h"), "i", F.lit(3)).count() == 0


def test_permutation_test(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0.4 * (i % 3 == 0), 1), i % 3 == 0) for i in range(120)] + [(500, 1.0, None)]
    got = stats.permutation_test(spark.createDataFrame(rows, "i int, s double, p boolean"), "s", F.col("p"), "i", 40).first().p
    x = rows[:-1]
    mean = lambda v: sum(v) / len(v)
    gap = lambda yes: mean([s for i, s, _ in x if i in yes]) - mean([s for i, s, _ in x if i not in yes])
    seen = {i for i, _, p in x if p}
    null = [gap(set(sorted((i for i, _, _ in x), key=lambda i: md5(f"{b}:{i}"))[: len(seen)])) for b in range(40)]
    assert got == pytest.approx((1 + sum(d >= gap(seen) for d in null)) / 41)


def test_group_constants(spark, monkeypatch):
    rows = [("a", 1.0), ("a", 3.0), (None, 2.0), (None, 2.0), ("z", 0.0), ("z", None), ("one", 5.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for limit in (1 << 20, 0):
        monkeypatch.setattr(ranks, "BROADCAST_ROWS", limit)
        shares = sorted(map(str, ((r.g, r.v, r.share) for r in R.shares(frame, ["g"], "v").collect())))
        assert shares == sorted(map(str, [("a", 1.0, 0.25), ("a", 3.0, 0.75), (None, 2.0, 0.5), (None, 2.0, 0.5), ("z", 0.0, 0.5), ("z", None, 0.5), ("one", 5.0, 1.0)]))
        z = {(r.g, r.v): r.z for r in R.zscore(frame, ["g"], "v").collect()}
        assert z[("a", 1.0)] == pytest.approx(-(0.5**0.5)) and z[("a", 3.0)] == pytest.approx(0.5**0.5)
        assert all(z[k] == 0 for k in z if k[0] != "a")


@pytest.mark.parametrize("down", [False, True])
def test_running_counts_over_many_parts(spark, down):
    rng = random.Random(5)
    values = [rng.choice([rng.randint(-40, 40), rng.random() * 50, float("inf"), float("-inf")]) for _ in range(3000)]
    frame = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "v double, g int")
    out = ranks.running_counts(frame, "v", {"n": F.lit(1).cast("long")}, down, per_bucket=5, by=("g",)).collect()
    for r in random.Random(6).sample(out, 300):
        own = [float(v) for i, v in enumerate(values) if i % 3 == r.g]
        assert r.n == own.count(r.v) and r.n_before == sum(x > r.v if down else x < r.v for x in own)


@pytest.mark.parametrize("down", [False, True])
def test_following_values(spark, down):
    values = random.Random(7).choices(range(200), k=400)
    frame = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v int, g int")
    out = ranks.running_counts(frame, "v", {"n": F.lit(1).cast("long")}, down, per_bucket=5, by=("g",), following="then").collect()
    for g in (0, 1):
        own = sorted({v for i, v in enumerate(values) if i % 2 == g}, reverse=down)
        assert {r.v: r.then for r in out if r.g == g} == dict(zip(own, [*own[1:], None]))


def test_wasserstein_over_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=90).round(1), rng.normal(0.5, 2, size=60).round(1)
    frame = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b] + [(None, True)], "v double, s boolean")
    plain = ranks.running_counts
    monkeypatch.setattr(stats, "running_counts", lambda *p, **k: plain(*p, **k, per_bucket=4))
    at = np.unique(np.concatenate([a, b]))
    below = lambda x: np.searchsorted(np.sort(x), at[:-1], "right") / len(x)
    assert stats.wasserstein(frame, "v", F.col("s")).first().distance == pytest.approx(float((np.abs(below(a) - below(b)) * np.diff(at)).sum()))


def test_bootstrap_interval(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "b"]), i, rng.gauss(0, 1)) for i in range(80)] + [("single", 5, 3.0), (None, 6, 1.0), ("a", None, 1.0), ("a", 900, None)]
    got = {r.g: r for r in stats.bootstrap_interval(spark.createDataFrame(rows, "g string, k int, v double"), "g", "v", "k", 60).collect()}
    assert set(got) == {"a", "b", "single"}
    for g, r in got.items():
        own = [v for h, k, v in sorted(x for x in rows if None not in x) if h == g]
        means = [np.mean([own[int(md5(f"{b}:{g}:{i}")[:8], 16) % len(own)] for i in range(len(own))]) for b in range(60)]
        assert r.n == len(own) and r.mean == pytest.approx(np.mean(own))
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))

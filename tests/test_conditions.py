"""Predictive information, conditional retrieval and energies against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import ranks
from quillon.operators import retrieval, vinformation

HELD = "part = 1"


def told(seed=1, n=400):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, n), rng.integers(0, 2, n)
    y = (a + b + (rng.random(n) < 0.1)) % 3
    f = pd.DataFrame({"a": a, "b": b, "c": rng.integers(0, 40, n), "y": y, "part": rng.random(n) < 0.3}).astype("int64")
    return f.astype(object).where(np.random.default_rng(2).random(f.shape) > 0.02, None).astype({"part": "float64"})


def lookup(f, columns, alpha):
    f = f[f["y"].notna() & f["part"].notna()]
    key = lambda r: tuple(None if pd.isna(r[c]) else r[c] for c in columns)
    train, held = f[f["part"] == 0], f[f["part"] == 1]
    classes = sorted(f["y"].unique())
    prior = {k: ((train["y"] == k).sum() + 1) / (len(train) + len(classes)) for k in classes}
    n, both = {}, {}
    for _, r in train.iterrows():
        n[key(r)] = n.get(key(r), 0) + 1
        both[key(r), r["y"]] = both.get((key(r), r["y"]), 0) + 1
    return np.mean([math.log((both.get((key(r), r["y"]), 0) + alpha * prior[r["y"]]) / (n.get(key(r), 0) + alpha)) for _, r in held.iterrows()])


def shares(value, d):
    """(marginal, conditional, shapley) of each feature by all orders."""
    orders = list(itertools.permutations(range(d)))
    out = []
    for j in range(d):
        before = [sum(1 << i for i in o[: o.index(j)]) for o in orders]
        out.append((value[1 << j] - value[0], value[(1 << d) - 1] - value[(1 << d) - 1 - (1 << j)], np.mean([value[m | 1 << j] - value[m] for m in before])))
    return out


def schema(f):
    return ", ".join(f"{c} {'double' if c == 'part' else 'long'}" for c in f.columns)


@pytest.mark.parametrize("alpha", [1.0, 0.25])
def test_tables_equal_brute_force(spark, alpha):
    f = told()
    frame = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in f.itertuples(index=False)], schema(f))
    got = {r["mask"]: r["value"] for r in vinformation.table_values(frame, "y", ["a", "b", "c"], F.expr(HELD), alpha).collect()}
    want = {m: lookup(f, [c for i, c in enumerate("abc") if m >> i & 1], alpha) for m in range(8)}
    assert got == pytest.approx(want, abs=1e-12)
    made = {r["feature"]: (r["marginal"], r["conditional"], r["shapley"]) for r in vinformation.information(spark.createDataFrame(list(got.items()), "mask long, value double"), ["a", "b", "c"]).collect()}
    for name, w in zip("abc", shares(want, 3)):
        assert made[name] == pytest.approx(w, abs=1e-12)
    assert made["a"][1] > 0.1 > made["c"][1]


def test_linear_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 0] + [1e4, 0, 5, 7]  # the last column is constant
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=300)
    held = rng.random(300) < 0.3
    rows = [(*map(float, x[i]), float(y[i]), int(held[i])) for i in range(300)] + [(None, 1.0, 1.0, 7.0, 1.0, 0), (1.0, float("nan"), 1.0, 7.0, 1.0, 1), (1.0, 1.0, float("inf"), 7.0, 1.0, 0), (1.0, 1.0, 1.0, 7.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, part int")
    got = {r["mask"]: r["value"] for r in vinformation.linear_values(frame, "y", list("abcd"), F.expr(HELD)).collect()}
    assert len(got) == 16
    for m, value in got.items():
        design = np.column_stack([np.ones(300), *(x[:, i] - x[:, i].mean() for i in range(4) if m >> i & 1)])
        w = np.linalg.lstsq(design[~held], y[~held], rcond=None)[0]
        variance = ((y - design @ w)[~held] ** 2).mean()
        want = (-0.5 * np.log(2 * np.pi * variance) - (y - design @ w)[held] ** 2 / 2 / variance).mean()
        assert value == pytest.approx(want, abs=1e-7)


def test_information_of_small_tables(spark):
    empty = spark.createDataFrame([], "a long, y long, part int")
    assert vinformation.table_values(empty, "y", ["a"], F.expr(HELD)).count() == 0
    assert vinformation.linear_values(empty, "y", ["a"], F.expr(HELD)).count() == 0
    trained = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "a long, y long, part int")
    assert vinformation.table_values(trained, "y", ["a"], F.expr(HELD)).count() == 0
    with pytest.raises(ValueError):
        vinformation.table_values(empty, "y", ["a"] * 21, F.expr(HELD))


SETS = {"none": [], "one": ["p"], "two": ["p", "q"], "three": ["p", "q", "r"], "last": ["r"]}


@pytest.mark.parametrize("block", [1024, 25])
def test_retrieval_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, size=(220, 5)).astype(float)  # many ties and equal rows
    y, train = rng.normal(size=220), rng.random(220) < 0.7
    rows = [(i, x[i, :2].tolist(), x[i, 2:3].tolist(), x[i, 3:].tolist(), float(y[i]), bool(train[i]), "s") for i in range(220)]
    odd = [(900, None, [0.0], [0.0, 0.0], 1.0, True, "s"), (901, [0.0, None], [0.0], [0.0, 0.0], 1.0, True, "s"), (902, [0.0, float("nan")], [0.0], [0.0, 0.0], 1.0, False, "s"), (903, [0.0, 0.0], [0.0], [0.0, 0.0], None, True, "s"), (None, [0.0, 0.0], [0.0], [0.0, 0.0], 1.0, True, "s"), (904, [0.0, 0.0], [0.0], [0.0, 0.0], 1.0, None, "s")]
    frame = spark.createDataFrame(rows + odd, "id long, p array<double>, q array<double>, r array<double>, y double, train boolean, set string")
    made = retrieval.conditional_retrieval(frame, "id", {c: c for c in "pqr"}, "y", F.col("train"), SETS, 4, block)
    got = {(r["id"], r["set"]): (r["predicted"], r["actual"]) for r in made.collect()}
    cut = {"p": slice(0, 2), "q": slice(2, 3), "r": slice(3, 5)}
    want = {}
    for i in np.flatnonzero(~train):
        for s, seen in SETS.items():
            near = sorted((sum(float(((x[i, cut[c]] - x[j, cut[c]]) ** 2).sum()) for c in seen), j) for j in np.flatnonzero(train))[:4]
            exact = [j for d, j in near if d == 0]
            mean = y[exact].mean() if exact else sum(y[j] / math.sqrt(d) for d, j in near) / sum(1 / math.sqrt(d) for d, _ in near)
            want[i, s] = mean, y[i]
    assert set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9)
    scores = {r["set"]: r for r in retrieval.skill(made).collect()}
    for s in SETS:
        errors = [(p - a) ** 2 for (_, t), (p, a) in want.items() if t == s]
        assert scores[s]["n"] == len(errors) and scores[s]["mse"] == pytest.approx(np.mean(errors)) and scores[s]["r2"] == pytest.approx(1 - np.mean(errors) / y[~train].var())
    assert retrieval.conditional_retrieval(frame.where("NOT train"), "id", {c: c for c in "pqr"}, "y", F.col("train"), SETS).count() == 0


def test_gains_find_the_direct_source(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=600), rng.normal(size=600)
    copy = b + 0.5 * rng.normal(size=600)  # tells of b, nothing beside it
    rows = [(i, [a[i]], [b[i]], [copy[i]], a[i] + 2 * b[i], i % 3 > 0) for i in range(600)]
    frame = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else [float(w) for w in v] if isinstance(v, list) else v for v in r) for r in rows], "id long, own array<double>, cause array<double>, echo array<double>, y double, train boolean")
    sets = retrieval.gain_sets("own", ["own", "cause", "echo"])
    assert sets == {"own": ["own"], "all": ["own", "cause", "echo"], "+cause": ["own", "cause"], "+echo": ["own", "echo"], "-cause": ["own", "echo"], "-echo": ["own", "cause"]}
    made = retrieval.gains(retrieval.skill(retrieval.conditional_retrieval(frame, "id", {c: c for c in ("own", "cause", "echo")}, "y", F.col("train"), sets)))
    assert {r["source"]: r["verdict"] for r in made.collect()} == {"cause": "direct", "echo": "indirect"}


@pytest.mark.parametrize("block", [1024, 20])
def test_energies_equal_brute_force(spark, block):
    rng = np.random.default_rng(6)
    series = {"one": rng.normal(size=(90, 3)), "two": 30 * rng.normal(size=(40, 3))}  # the second underflows without its largest term
    rows = [(s, t, x[t].tolist(), float(x[t].sum())) for s, x in series.items() for t in range(len(x))]
    odd = [("one", 500, None, 1.0), ("one", 501, [0.0, float("inf"), 0.0], 1.0), (None, 1, [0.0] * 3, 1.0), ("lone", 1, [0.0] * 3, 1.0), ("one", 502, [0.0] * 3, None)]
    frame = spark.createDataFrame(rows + odd, "system string, t long, x array<double>, y double")
    got = {(r["system"], r["t"], r["kernel"], r["beta"]): r for r in retrieval.energies(frame, "t", "system", "x", "y", [0.5, 4.0], 3, block).collect()}
    assert len(got) == 4 * 130
    for s, x in series.items():
        y = x.sum(1)
        for t in range(len(x)):
            far = np.abs(np.arange(len(x)) - t) > 3
            d2 = ((x[far] - x[t]) ** 2).sum(1)
            for kernel, like in (("distance", -d2 / 2), ("dot", x[far] @ x[t])):
                for beta in (0.5, 4.0):
                    w = np.exp(beta * (like - like.max()))
                    r = got[s, t, kernel, beta]
                    assert r["n"] == far.sum() and r["nearest"] == pytest.approx(np.sqrt(d2.min()), abs=1e-6)
                    assert r["energy"] == pytest.approx(-(beta * like.max() + np.log(w.mean())) / beta, abs=1e-7)
                    assert r["error"] == pytest.approx(abs(w @ y[far] / w.sum() - y[t]), abs=1e-6)


@pytest.mark.parametrize("per_bucket", [1 << 16, 7])
def test_ranks_of_groups(spark, per_bucket, monkeypatch):
    rng = np.random.default_rng(7)
    f = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 300, p=[0.7, 0.25, 0.05]), "x": rng.integers(0, 30, 300).astype(float), "e": rng.normal(size=300).round(1)})
    f.loc[f["g"] == "c", "x"] = 1.0
    frame = spark.createDataFrame([*f.itertuples(index=False, name=None), (None, 1.0, 1.0), ("a", None, 1.0)], "g string, x double, e double")
    plain = ranks.running_counts
    monkeypatch.setattr(retrieval, "running_counts", lambda *a, **k: plain(*a, **k, per_bucket=per_bucket))
    got = {r["g"]: r for r in retrieval.rank_correlation(frame, "x", "e", ("g",)).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"]["rho"] is None
    for g in "ab":
        own = f[f["g"] == g]
        assert got[g]["n"] == len(own) and got[g]["rho"] == pytest.approx(own["x"].rank().corr(own["e"].rank()))
    whole = retrieval.rank_correlation(frame.where("g IS NOT NULL"), "x", "e").first()
    assert whole["n"] == 300 and whole["rho"] == pytest.approx(f["x"].rank().corr(f["e"].rank()))

"""Neighbour information, pool nulls and split halves against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import information as I


def psi(n):
    return -I.EULER + sum(1 / i for i in range(1, n))


def brute(rows, k=3):
    rows = [(x, c) for x, c in rows if x is not None and c is not None and not math.isnan(x)]
    size = {c: sum(d == c for _, d in rows) for _, c in rows}
    rows = [(x, c) for x, c in rows if size[c] > 1]
    terms = []
    for i, (x, c) in enumerate(rows):
        used = min(k, size[c] - 1)
        r = sorted(abs(x - y) for j, (y, d) in enumerate(rows) if d == c and j != i)[used - 1]
        m = sum(x - r < y < x + r if r else y == x for y, _ in rows)
        terms.append(psi(used) - psi(size[c]) - psi(m))
    return max(0.0, psi(len(rows)) + sum(terms) / len(terms))


def test_class_information(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal() + 2 * (i % 3)), "abc"[i % 3]) for i in range(200)] + [(float(i % 4), "abd"[i % 3]) for i in range(90)]
    rows += [(5.0, "lone"), (1.0, "pair"), (9.0, "pair"), (None, "a"), (1.0, None), (float("nan"), "a")]
    frame = spark.createDataFrame(rows, "v double, label string")
    assert I.class_information(frame, "v", "label").first()[0] == pytest.approx(brute(rows), abs=1e-9)
    assert I.class_information(frame.limit(0), "v", "label").first()[0] is None


def test_typed_columns(spark):
    frame = spark.range(400).select((F.col("id") % 2 == 0).alias("same"), F.rand(3).alias("noise"), (F.col("id") % 2).alias("label"))
    out = {r.column: (r.kind, r.information) for r in I.typed_information(frame, ["same", "noise"], "label").collect()}
    assert out["same"] == ("discrete", pytest.approx(math.log(2))) and out["noise"][0] == "continuous" and out["noise"][1] < 0.1


def test_digamma_and_positions(spark):
    got = spark.range(1, 60).select("id", I.digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-11) for r in got)
    frame = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(37)).alias("v"), "id").repartition(5)
    got = I.numbered(frame, "v", "id").orderBy("position").collect()
    assert [r.position for r in got] == list(range(500)) and [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_split_halves(spark):
    rng = np.random.default_rng(2)
    rows = [("five", u, float(rng.normal())) for u in range(5) for _ in range(u + 1)] + [("three", u, 1.0) for u in range(3)] + [("five", 9, None)]
    got = {r.item: r for r in I.split_half_floor(spark.createDataFrame(rows, "item string, unit int, value double")).collect()}
    ds = []
    for comb in itertools.combinations(range(5), 2):
        own = [v for i, u, v in rows if i == "five" and u in comb and v is not None]
        other = [v for i, u, v in rows if i == "five" and u not in comb and v is not None]
        ds.append(np.mean(other) - np.mean(own))
    assert got["five"].deviation == pytest.approx(np.std(ds)) and got["five"].largest == pytest.approx(np.max(np.abs(ds))) and got["three"].deviation is None
    with pytest.raises(ValueError):
        I.split_half_floor(spark.range(17).select(F.lit("x").alias("item"), F.col("id").alias("unit"), F.lit(1.0).alias("value")))


def test_pool_null_finds_a_shift(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"i{i % 4}", i % 2 if i % 4 > 1 else (i // 4) % 2, float(rng.random())) for i in range(800)]
    rows = [(i, item, (i // 4) % 2, min(1.0, v + 0.5 * (item == "i1" and (i // 4) % 2))) for i, item, _, v in rows] + [(900, "only", 1, 0.5), (901, None, 0, 0.5), (902, "i0", 0, None)]
    got = {r.item: r for r in I.pool_null(spark.createDataFrame(rows, "id long, item string, cohort int, value double"), 60).collect()}
    assert set(got) == {"i0", "i1", "i2", "i3"} and got["i1"].p_identity < 0.02 and got["i1"].delta > 0.2
    assert all(abs(r.null_mean) < 0.2 for r in got.values()) and max(got[i].p_identity for i in ("i0", "i2", "i3")) > 0.02


def test_copies_and_runs_of_class_information(spark, monkeypatch):
    """Copies count as rows though each value is kept once, and neighbours are found across runs of positions."""
    monkeypatch.setattr(I, "RUN", 5)
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal() + i % 2), "ab"[i % 2]) for i in range(60)] + [(float(i % 3) / 2, "abc"[i % 3]) for i in range(24)] + [(7.0, "d"), (7.5, "d"), (-0.0, "c")]
    frame = spark.createDataFrame(rows, "v double, label string")
    kept = []
    monkeypatch.setattr(I, "settled", lambda df, old=I.settled: kept.append(old(df)) or kept[-1])
    assert I.class_information(frame, "v", "label").first()[0] == pytest.approx(brute(rows), abs=1e-9)
    assert max(df.count() for df in kept[:2]) == len({(x, c) for x, c in rows}) < len(rows)

"""Queries that SQL can't express, against plain numpy over the whole tables."""

import numpy as np
import pytest

from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_discount", "l_tax").toPandas()


def explained(y, x):
    design = np.column_stack([np.ones(len(y)), *x])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    return 1 - rest.var() / y.var()


def test_participation_ratio(spark, items):
    values = np.linalg.eigvalsh(np.corrcoef(items.to_numpy().T))[::-1]
    row = QUERIES["sta30_participation_ratio"](spark, SF).first()
    assert row.participation == pytest.approx(values.sum() ** 2 / (values**2).sum(), rel=1e-9)
    assert row.n_95 == int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)


def test_group_losses(spark, items):
    y, columns = items["l_extendedprice"].to_numpy(), {"amount": ["l_quantity"], "rates": ["l_discount", "l_tax"]}
    every = explained(y, [items[c] for c in ("l_quantity", "l_discount", "l_tax")])
    got = {r.group: r.loss for r in QUERIES["red05_group_losses"](spark, SF).collect()}
    for name in columns:
        left = [items[c] for k, own in columns.items() if k != name for c in own]
        assert got[name] == pytest.approx(every - explained(y, left), abs=1e-9)


def test_stouffer(spark):
    from statistics import NormalDist

    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("source", "quality").toPandas().groupby("source")["quality"]
    z, w = [], []
    for _, own in rows:
        if own.notna().any():
            z.append(-NormalDist().inv_cdf(min(max(own.mean(), 1e-12), 1 - 1e-12)))
            w.append(np.sqrt(len(own)))
    row = QUERIES["sta16_stouffer"](spark, SF).first()
    want = np.dot(w, z) / np.sqrt(np.dot(w, w))
    assert row.z == pytest.approx(want) and row.p == pytest.approx(1 - NormalDist().cdf(want), abs=1e-12)


def test_signed_ranks(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    means = events.groupby(["user_id", "event_type"])["value"].mean().unstack()
    for r in QUERIES["sta18_wilcoxon"](spark, SF).collect():
        d = (means[r.event_type] - means["view"]).dropna().to_numpy()
        d = d[d != 0]
        order = np.argsort(np.abs(d))
        ranks = np.empty(len(d))
        ranks[order] = np.arange(1, len(d) + 1)
        at, n = ranks[d > 0].sum(), len(d)
        ways = {0: 1}
        for k in range(1, n + 1):
            ways = {s: ways.get(s, 0) + ways.get(s - k, 0) for s in {*ways, *(x + k for x in ways)}}
        low = sum(v for s, v in ways.items() if s <= at) / 2**n
        high = sum(v for s, v in ways.items() if s >= at) / 2**n
        assert len(set(np.abs(d))) < n or r.p == pytest.approx(min(1, 2 * min(low, high)), rel=1e-9)


def test_gates_follow_the_donors(spark):
    row = QUERIES["drv08_gates"](spark, SF).first()
    assert row.rows < 2000 and not row.long_enough and row.saturated == (row.donors >= 8) and row.self_r2_max >= row.self_r2_median
    assert row.donor_share * 12 == pytest.approx(row.donors) and row.clean_ghosts == (row.ghost_median <= 0.005) and row.ghost_max >= row.ghost_median

"""Grids of settings: stopped half way, they go on; rows equal direct work."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import parameters, scan


def test_cells():
    centre = {"n": 100, "coupling": 0.5}
    assert parameters.around(centre, {"n": [50, 100], "coupling": [0.1, 0.5]}) == [{"n": 50, "coupling": 0.5}, centre, {"n": 100, "coupling": 0.1}]
    assert len(parameters.crossed({"a": [1, 2], "b": [1, 2, 3]})) == 6


def test_a_stopped_grid_goes_on(spark, tmp_path):
    folder, worked = str(tmp_path / "grid"), []
    cells = parameters.crossed({"a": [1, 2, 3], "name": ["x", "y"]})

    def work(cell, fail=None):
        worked.append((cell["a"], cell["name"]))
        value = F.lit(cell["a"] * 10.0)
        if worked[-1] == fail:
            value = F.raise_error(F.lit("lost")).cast("double")
        return spark.range(2).select("id", value.alias("value"))

    with pytest.raises(Exception, match="lost"):
        parameters.run_grid(spark, cells, lambda c: work(c, (2, "y")), folder, 2)
    kept = parameters.finished(spark, folder)
    assert {(r["a"], r["name"]) for r in kept.collect()} == {(1, "x"), (1, "y")}  # the wave that failed is not there
    whole = tmp_path / "grid" / "wave-torn"
    whole.mkdir()
    kept.limit(1).withColumn("a", F.lit(99)).write.mode("append").parquet(str(whole))
    (whole / "_SUCCESS").unlink()  # as if the driver had been lost while it wrote
    worked.clear()
    out = parameters.run_grid(spark, [*cells, cells[0]], work, folder, 3).collect()
    assert worked == [(2, "x"), (2, "y"), (3, "x"), (3, "y")]
    assert sorted((r["a"], r["name"], r["id"], r["value"]) for r in out) == sorted((c["a"], c["name"], i, c["a"] * 10.0) for c in cells for i in (0, 1))
    worked.clear()
    assert parameters.run_grid(spark, cells, work, folder).count() == 12 and not worked
    with pytest.raises(ValueError):
        parameters.run_grid(spark, [], work, folder)


def test_predictability_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    for t in range(1, 400):
        x[t, 0] += 0.99 * x[t - 1, 0]
        x[t, 1] = np.sin(t / 9)
    frame = pd.DataFrame([(f"c{j}", t, float(x[t, j])) for j in range(4) for t in range(400)], columns=["channel", "t", "value"])
    series = spark.createDataFrame(frame)
    got = parameters.predictability(series, False, 3, 1.0).first()
    rows = scan.states(series, scan.ScanConfig(difference=False)).toPandas()
    want = []
    for _, f in rows.groupby("channel"):
        own, y, train = np.stack(f["own"]), f["target"].to_numpy(), f["train"].to_numpy()
        want.append(scan.ridge_r2(own[train], y[train], own[~train], y[~train]))
    assert got["channels"] == 4 and got["median_r2"] == pytest.approx(np.median(want)) and got["saturated"] == np.mean(np.array(want) > 0.9)
    assert 0 < got["saturated"] < 1

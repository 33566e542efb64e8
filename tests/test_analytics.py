"""Invariants, known truths, negative controls and exact small cases."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import ranks, scalar, stats
from quillon.operators import causal, importance, manifold, redundancy, scan
from quillon.operators import relational as R
from quillon.sources import files, generators


def test_symbol_root_strips_digits_before_the_letter(spark):
    names = ["RPL13A", "RPL13", "TP53", "AB1", "ABCD", "XYZQ12"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select("s", scalar.symbol_root(F.col("s")).alias("r")).collect()
    assert {r.s: r.r for r in got} == {"RPL13A": "RPL13", "RPL13": "RPL", "TP53": "TP53", "AB1": "AB1", "ABCD": "ABC", "XYZQ12": "XYZ"}


def test_contacts(spark):
    got = spark.createDataFrame([("A'3-A'4",), ("lap:B5",), ("C7",)], "d string").select(scalar.derivation_contacts(F.col("d")).alias("c")).collect()
    assert [r.c for r in got] == [["A'3", "A'4"], ["B4", "B5", "B6"], ["C7"]]


def test_running_counts_in_parts(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 500)
    df = spark.createDataFrame([(int(v),) for v in values], "v int")
    for down in (False, True):
        out = ranks.running_counts(df, "v", {"n": F.lit(1).cast("long")}, down, per_bucket=7).toPandas()
        for r in out.itertuples():
            assert r.n == (values == r.v).sum() and r.n_before == ((values > r.v) if down else (values < r.v)).sum()


def test_exact_tails(spark):
    df = spark.createDataFrame([(2, 10, 4, 3), (0, 10, 4, 3)], "k int, population int, marked int, drawn int")
    got = [r[0] for r in df.select(stats.hypergeometric_sf("k", "population", "marked", "drawn")).collect()]
    assert got[0] == pytest.approx((math.comb(4, 2) * 6 + math.comb(4, 3)) / math.comb(10, 3)) and got[1] == pytest.approx(1)
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([1.0, -1.0],)], "d array<double>")
    assert [r[0] for r in df.select(stats.wilcoxon_exact("d")).collect()] == pytest.approx([2 / 32, 1.0])


def test_cka_is_invariant():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 6))
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    assert stats.linear_cka(a, 3 * a @ turn + 5) == pytest.approx(1)
    assert math.isnan(stats.linear_cka(a, np.ones((40, 2))))
    with pytest.raises(ValueError):
        stats.linear_cka(a, a[:10])


def test_shapley_is_efficient_and_symmetric(spark):
    rng = np.random.default_rng(2)
    values = [(m, float(rng.random()) if m else 0.0) for m in range(16)]
    table = dict(values)
    out = {r.feature: r.shapley for r in redundancy.shapley(spark.createDataFrame(values, "mask long, value double"), list("abcd")).collect()}
    assert sum(out.values()) == pytest.approx(table[15])
    brute = np.zeros(4)
    for order in itertools.permutations(range(4)):
        mask = 0
        for j in order:
            brute[j] += (table[mask | 1 << j] - table[mask]) / 24
            mask |= 1 << j
    assert [out[f] for f in "abcd"] == pytest.approx(brute.tolist())
    assert redundancy.sampled_shapley(table, 4, 4000, 0) == pytest.approx(brute, abs=0.05)


def test_redundancy_finds_copies(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "copy": 2 * a + 1, "b": b}))
    out = {r.feature: r.verdict for r in redundancy.redundancy_scores(df, ["a", "copy", "b"]).collect()}
    assert out == {"a": "redundant", "copy": "redundant", "b": "unique"}


def test_embedding_contract():
    points, times = manifold.delay_embed(np.arange(6.0), 3, 2)
    assert points.tolist() == [[4, 2, 0], [5, 3, 1]] and times.tolist() == [4, 5]
    for bad in ((0, 1), (1, 0), (4, 2)):
        with pytest.raises(ValueError):
            manifold.delay_embed(np.arange(6.0), *bad)


def test_simplex_excludes_near_times():
    x = np.sin(np.arange(60) * 0.7)
    m, t = manifold.delay_embed(x, 2, 1)
    seen = manifold.simplex_predict(m, t, x[t], m, t, radius=3)
    for i in (10, 30):
        d = np.linalg.norm(m - m[i], axis=1)
        d[np.abs(t - t[i]) <= 3] = np.inf
        near = np.argsort(d, kind="stable")[:3]
        w = np.maximum(np.exp(-d[near] / d[near[0]]), 1e-6)
        assert seen[i] == pytest.approx((w * x[t][near]).sum() / w.sum())


def test_surrogates_keep_spectrum_and_values():
    x = np.random.default_rng(4).normal(size=64).cumsum()
    s = manifold.phase_surrogate(x, 1)
    assert np.allclose(np.abs(np.fft.rfft(s)), np.abs(np.fft.rfft(x))) and s.mean() == pytest.approx(x.mean())
    assert sorted(manifold.shift_surrogate(x, 1)) == sorted(x)


def test_direction_of_coupled_maps(spark):
    made = generators.coupled_logistic(spark, [0, 1], 250)
    verdicts = manifold.convergence(manifold.convergent_cross_mapping(made, 2, replicates=4, sizes=[20, 80, 249]))
    assert {r.dominant for r in manifold.dominant_direction(verdicts).collect()} == {"x"}
    apart = generators.coupled_logistic(spark, [0, 1], 250, ry=3.7, coupling=0.0)
    assert not any(r.converges for r in manifold.convergence(manifold.convergent_cross_mapping(apart, 2, replicates=4, sizes=[20, 80, 249])).collect())


def test_scan_finds_driven_channels(spark):
    made = generators.coupled_system(spark, 0, 900, 12, 4)
    result, ghosts, gates = scan.scan(made, scan.ScanConfig(degree=2, ghosts=12, difference=False))
    out = result.toPandas().sort_values("excess", ascending=False)
    truth = {r.channel for r in generators.system_truth(spark, 12, 4).collect() if r.is_driven}
    assert len(set(out["channel"][:4]) & truth) >= 3
    assert out[out["channel"].isin(truth)]["excess"].mean() > out[~out["channel"].isin(truth)]["excess"].mean()
    assert ghosts.agg(F.median("excess")).first()[0] < 0.05
    assert set(gates.columns) == {"rows", "ghost_median", "ghost_max", "driven_share", "self_r2_median", "self_r2_max", "donor_share", "donors", "long_enough", "saturated", "clean_ghosts"}


def test_noise_models_orient_a_cubic(spark):
    out = {r.pair: r.verdict for r in causal.anm_orient(generators.noisy_pairs(spark, 600), draws=99).collect()}
    assert out == {"forward": "x->y", "backward": "y->x", "independent": "independent"}


def test_gates_rank_signal_over_noise(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * (x[:, 0] + x[:, 1])))).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef")).assign(y=y))
    out = importance.summarise(importance.run_gates(df, list("abcdef"), "y", runs=4)).toPandas().sort_values("importance", ascending=False)
    assert set(out["feature"][:2]) == {"a", "b"} and out["importance"].sum() == pytest.approx(1)
    assert ((out["ci_low"] <= out["importance"]) & (out["importance"] <= out["ci_high"])).all()


def test_summary_of_fixed_runs(spark):
    runs = spark.createDataFrame([(s, f, g) for s, gates in enumerate([(1.0, 1.0, 8.0), (100.0, 100.0, 800.0), (0.0, 0.0, 0.0)]) for f, g in zip("abc", gates)], "seed int, feature string, gate double")
    out = {r.feature: r.importance for r in importance.summarise(runs, draws=50).collect()}
    assert out == pytest.approx({"a": 0.1, "b": 0.1, "c": 0.8})


def test_trial_effect_is_covered(spark):
    covered = 0
    for seed in range(0, 80, 20):
        row = generators.trial(spark, 2000, seed).agg(*(f(F.when(F.col("treatment") == k, F.col("outcome"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)))).first()
        effect, se = row.m1 - row.m0, math.sqrt(row.v1 / row.n1 + row.v0 / row.n0)
        covered += abs(effect - 1) < 1.96 * se + 0.05
    assert covered >= 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.0,2.0,0\n?,3.0,1\n4.0,5.0,1\n")
    rows, dropped = files.read_attributes(spark, f"file://{tmp_path}/a.csv", ["x", "y", "num"])
    assert rows.count() == 2 and dropped.first()["dropped"] == 1
    (tmp_path / "names").write_text("x, y ,num\n")
    assert files.read_names(spark, f"file://{tmp_path}/names") == ["x", "y", "num"]
    (tmp_path / "m.csv").write_text("a,b\n1,2\n3,4\n")
    assert sorted(files.read_matrix(spark, f"file://{tmp_path}/m.csv").collect()) == [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0), (1, "b", 4.0)]
    (tmp_path / "e.csv").write_text("id,AA (1),BB (2),AA (3)\nk1,1,2,9\nk2,,4,9\n")
    assert sorted(map(str, files.read_entities(spark, f"file://{tmp_path}/e.csv").collect())) == sorted(map(str, spark.createDataFrame([("k1", "AA", 1.0), ("k1", "BB", 2.0), ("k2", "AA", None), ("k2", "BB", 4.0)], "key string, entity string, value double").collect()))
    np.savez(tmp_path / "n200_V10.npz", z=np.arange(4.0).reshape(2, 2))
    got = files.read_arrays(spark, f"file://{tmp_path}/n200_V10.npz").collect()
    assert [r.values for r in got] and got[0].params == {"n": 200.0, "V": 10.0} and [r["values"] for r in got] == [[0, 1], [2, 3]]


def test_edf_round_trip(spark, tmp_path):
    labels, samples, records = ["C3", "C4", "slow"], [4, 4, 1], 3
    head = "0".ljust(8) + "x".ljust(80) + "y".ljust(80) + "01.01.2001.01.01" + str(256 * 4).ljust(8) + " " * 44 + str(records).ljust(8) + "1".ljust(8) + "3".ljust(4)
    per = [[x.ljust(16) for x in labels], ["".ljust(80)] * 3, ["uV".ljust(8)] * 3, ["-100".ljust(8)] * 3, ["100".ljust(8)] * 3, ["-1000".ljust(8)] * 3, ["1000".ljust(8)] * 3, ["".ljust(80)] * 3, [str(s).ljust(8) for s in samples], ["".ljust(32)] * 3]
    data = np.arange(records * sum(samples), dtype="<i2")
    (tmp_path / "r.edf").write_bytes((head + "".join("".join(p) for p in per)).encode() + data.tobytes())
    got = {r.channel: r["values"] for r in files.read_edf(spark, f"file://{tmp_path}/r.edf").collect()}
    assert set(got) == {"C3", "C4"} and got["C3"] == pytest.approx([(9 * r + i) / 10 for r in range(3) for i in range(4)])


def test_append_new_resumes(spark, tmp_path):
    path = f"file://{tmp_path}/done"
    files.append_new(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    files.append_new(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_table_equality_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert R.same_rows(a, a.repartition(2)) and not R.same_rows(a, a.distinct())


def test_streaming_windows_equal_batch(spark, tmp_path):
    from quillon.streaming import windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    job = windows.tumbling(stream, "1 hour", "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        job.processAllAvailable()
        assert R.same_rows(spark.table("tumbled"), windows.tumbling(events, "1 hour"))
    finally:
        job.stop()

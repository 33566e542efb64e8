"""Gated feature selection: an ensemble of small networks behind non-negative feature gates, and its ranked summary.

A run is one seed; runs are independent tasks over the same cleaned table. Gates shrink by a soft threshold and bound the weights
behind them (a feature whose gate is 0 can't act); networks are numpy, one hidden layer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import position_rank


def shrink(gates: np.ndarray, by: float) -> np.ndarray:
    """The proximal step of an l1 penalty on non-negative gates."""
    return np.maximum(gates - by, 0)


def bound_weights(weights: np.ndarray, gates: np.ndarray, most: float) -> np.ndarray:
    """Each feature's weights held within most * gate."""
    return np.clip(weights, -most * gates[:, None], most * gates[:, None])


def soft_f1_loss(p: np.ndarray, y: np.ndarray) -> float:
    """1 - F1 with probabilities in place of decisions."""
    hit = (p * y).sum()
    return float(1 - 2 * hit / (2 * hit + (p * (1 - y)).sum() + ((1 - p) * y).sum() + 1e-12))


def input_relevance(x: np.ndarray, w: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Mean |gradient * input| of each column for the network tanh(x w + b) v."""
    h = np.tanh(x @ w + b)
    return np.abs(((1 - h**2) * v) @ w.T * x).mean(axis=0)


def train_gates(x: np.ndarray, y: np.ndarray, groups: np.ndarray, seed: int, l1: float = 0.5, hidden: int = 16, epochs: int = 60, rate: float = 0.01, most: float = 10.0, batch: int = 64) -> tuple[np.ndarray, float]:
    """(gate of each feature, held-out accuracy) of one network; groups maps columns to features; a fifth of the rows is held out."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    test, train = order[: len(x) // 5], order[len(x) // 5 :]
    mean, spread = x[train].mean(0), x[train].std(0)
    x = (x - mean) / np.where(spread > 0, spread, 1)
    n_features = int(groups.max()) + 1
    gates = np.full(n_features, 1.0)
    p = {"w": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b": np.zeros(hidden), "v": rng.normal(0, hidden**-0.5, hidden), "c": np.zeros(1)}
    share = np.bincount(y.astype(int), minlength=2) / len(y)
    weight = np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    state = {k: (np.zeros_like(q), np.zeros_like(q)) for k, q in (p | {"g": gates}).items()}
    step = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            at, step = train[i : i + batch], step + 1
            gated = x[at] * gates[groups]
            h = np.tanh(gated @ p["w"] + p["b"])
            out = 0.5 * (1 + np.tanh(0.5 * (h @ p["v"] + p["c"])))
            d = (out - y[at]) * weight[at] / len(at)
            dh = np.outer(d, p["v"]) * (1 - h**2)
            dx = dh @ p["w"].T
            grad = {"w": gated.T @ dh, "b": dh.sum(0), "v": h.T @ d, "c": d.sum(keepdims=True), "g": np.bincount(groups, (dx * x[at]).sum(0), n_features)}
            for k, g in grad.items():
                m, s = state[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g**2 - s)
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                if k == "g":
                    gates = shrink(gates - move, rate * l1)
                else:
                    p[k] = p[k] - move
            p["w"] = bound_weights(p["w"], gates[groups], most)
    seen = np.tanh((x[test] * gates[groups]) @ p["w"] + p["b"]) @ p["v"] + p["c"] > 0
    return gates, float((seen == (y[test] > 0)).mean()) if len(test) else float("nan")


def run_gates(df: DataFrame, columns: list[str], label: str, runs: int = 10, sample_rows: int = 20_000, **settings) -> DataFrame:
    """(seed, feature, gate, accuracy) of each run; every run fits a bounded sample of rows, chosen by hash of their values."""
    spark = df.sparkSession
    clean = df.select(*(F.col(c).cast("double").alias(c) for c in columns), F.col(label).cast("int").alias("_y")).dropna()
    sample = clean.orderBy(F.xxhash64(*columns, "_y")).limit(sample_rows).toPandas()
    x, y = sample[columns].to_numpy(), sample["_y"].to_numpy()
    data = spark.sparkContext.broadcast((x, y))

    def run(frames):
        for frame in frames:
            for seed in frame["id"]:
                own_x, own_y = data.value
                gates, accuracy = train_gates(own_x, own_y, np.arange(len(columns)), int(seed), **settings)
                yield pd.DataFrame({"seed": seed, "feature": columns, "gate": gates, "accuracy": accuracy})

    return spark.range(0, runs, numPartitions=runs).mapInPandas(run, "seed long, feature string, gate double, accuracy double")


def summarise(runs: DataFrame, draws: int = 2000, keep: float = 0.0) -> DataFrame:
    """(feature, importance, ci_low, ci_high, std, mean_rank, selected_frac), best first in meaning, not in order.

    A run's gates become shares (all-zero runs go); intervals are percentile bootstraps over runs, whose resamples are drawn by hash.
    """
    total = F.sum("gate").over(Window.partitionBy("seed"))
    shares = runs.withColumn("_t", total).where("_t > 0").withColumn("share", F.col("gate") / F.col("_t"))
    shares = shares.withColumn("rank", position_rank(["seed"], "share", "feature", descending=True))
    seeds = shares.select("seed").distinct().withColumn("_i", F.row_number().over(Window.orderBy("seed")) - 1)  # one row a run
    n = seeds.agg(F.count(F.lit(1)).alias("_n"))
    picks = shares.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(seeds.join(n))).select("draw", F.pmod(F.xxhash64(F.lit(11), "draw", "_i"), F.col("_n")).alias("_i"))
    drawn = picks.join(seeds, "_i").join(shares.select("seed", "feature", "share"), "seed").groupBy("draw", "feature").agg(F.avg("share").alias("m"))
    interval = drawn.groupBy("feature").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    table = shares.groupBy("feature").agg(F.avg("share").alias("importance"), F.stddev_samp("share").alias("std"), F.avg("rank").alias("mean_rank"), F.avg((F.col("gate") > keep).cast("int")).alias("selected_frac"))
    return table.join(interval, "feature").select("feature", "importance", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "std", "mean_rank", "selected_frac")

"""Synthetic systems with known truth, as long tables. Recurrences run one seed a task; independent rows are Spark expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid


def logistic_pair(n: int, rx: float, ry: float, coupling: float, x0: float, y0: float, burn: int) -> tuple[np.ndarray, np.ndarray]:
    """Two logistic maps, x driving y with the given strength."""
    x, y, out = x0, y0, np.empty((n + burn, 2))
    for i in range(n + burn):
        out[i] = x, y
        x, y = rx * x * (1 - x), min(max(y * (ry - ry * y - coupling * x), 1e-9), 1 - 1e-9)
    return out[burn:, 0], out[burn:, 1]


def coupled_logistic(spark: SparkSession, seeds: list[int], n: int, rx: float = 3.8, ry: float = 3.5, coupling: float = 0.32, burn: int = 300) -> DataFrame:
    """(system, t, x, y); a coupling of 0 gives independent maps."""

    def run(frames):
        for frame in frames:
            for seed in frame["seed"]:
                rng = np.random.default_rng(seed)
                x, y = logistic_pair(n, rx, ry, coupling, 0.1 + 0.8 * rng.random(), 0.1 + 0.8 * rng.random(), burn)
                yield pd.DataFrame({"system": str(seed), "t": np.arange(n), "x": x, "y": y})

    return spark.createDataFrame([(s,) for s in seeds], "seed long").mapInPandas(run, "system string, t long, x double, y double")


def chaotic_flow(spark: SparkSession, seeds: list[int], n: int, coupling: float = 2.0, step: float = 0.01, stride: int = 5) -> DataFrame:
    """(system, t, x, y): the second coordinates of a Roessler flow and of a Lorenz flow that it drives, by fourth-order steps."""

    def slope(s):
        a, b, c, x, y, z = s
        return np.array([-6 * (b + c), 6 * (a + 0.2 * b), 6 * (0.2 + c * (a - 5.7)), 10 * (y - x), 28 * x - y - x * z + coupling * b * b, x * y - 8 / 3 * z])

    def run(frames):
        for frame in frames:
            for seed in frame["seed"]:
                s, out = np.random.default_rng(seed).random(6), []
                for i in range((n + 400) * stride):
                    k1 = slope(s)
                    k2 = slope(s + step / 2 * k1)
                    k3 = slope(s + step / 2 * k2)
                    k4 = slope(s + step * k3)
                    s = s + step / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
                    if i >= 400 * stride and i % stride == 0:
                        out.append((s[1], s[4]))
                yield pd.DataFrame({"system": str(seed), "t": np.arange(n), "x": [o[0] for o in out], "y": [o[1] for o in out]})

    return spark.createDataFrame([(s,) for s in seeds], "seed long").mapInPandas(run, "system string, t long, x double, y double")


def coupled_system(spark: SparkSession, seed: int, n: int, channels: int, driven: int, strength: float = 0.35) -> DataFrame:
    """(t, channel, value): logistic maps of which the last `driven` drive the first; channel names sort by number."""

    def run(frames):
        for frame in frames:
            for s in frame["id"]:
                rng = np.random.default_rng(int(s))
                rate, x, out = rng.uniform(3.6, 3.9, channels), rng.uniform(0.2, 0.8, channels), np.empty((n + 200, channels))
                for i in range(n + 200):
                    out[i] = x
                    own = rate * x * (1 - x)
                    own[:driven] = (1 - strength) * own[:driven] + strength * x[channels - driven :]
                    x = np.clip(own, 1e-6, 1 - 1e-6)
                values = out[200:]
                yield pd.DataFrame({"t": np.repeat(np.arange(n), channels), "channel": [f"c{j:04d}" for j in range(channels)] * n, "value": values.ravel()})

    return spark.range(seed, seed + 1, numPartitions=1).mapInPandas(run, "t long, channel string, value double")


def system_truth(spark: SparkSession, channels: int, driven: int) -> DataFrame:
    return spark.createDataFrame([(f"c{j:04d}", j < driven, j >= channels - driven) for j in range(channels)], "channel string, is_driven boolean, is_source boolean")


def nonlinear_causes(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Rows with two causes, two confounded columns, an effect, three noises and a binary outcome."""
    base = spark.range(n).select("id", F.randn(seed).alias("z"), F.randn(seed + 1).alias("x_cause1"), F.randn(seed + 2).alias("x_cause2"), *(F.randn(seed + 3 + k).alias(f"x_noise{k + 1}") for k in range(3)), F.randn(seed + 7).alias("_e"), F.rand(seed + 8).alias("_u"))
    score = 1.5 * F.sin(2 * F.col("x_cause1")) + F.col("x_cause2") * F.col("x_cause2") - 1 + F.col("z")
    out = base.withColumn("y", (F.col("_u") < sigmoid(score)).cast("int"))
    return out.select("id", "z", (F.col("z") + 0.3 * F.col("x_noise1")).alias("x_conf1"), (F.col("z") * F.col("z") + 0.3 * F.col("x_noise2")).alias("x_conf2"), "x_cause1", "x_cause2", (F.col("y") + 0.5 * F.col("_e")).alias("x_effect"), "x_noise1", "x_noise2", "x_noise3", "y")


def parity(spark: SparkSession, n: int, bits: int, seed: int) -> DataFrame:
    """Random bits, their parity over the first four as `y`, and `summary`, a noisy copy of it."""
    rows = spark.range(n).select("id", *((F.rand(seed + k) < 0.5).cast("int").alias(f"bit_{k}") for k in range(bits)), F.rand(seed + bits).alias("_u"))
    y = (F.col("bit_0") + F.col("bit_1") + F.col("bit_2") + F.col("bit_3")) % 2
    return rows.select("id", *(f"bit_{k}" for k in range(bits)), y.alias("y"), F.when(F.col("_u") < 0.95, y).otherwise(1 - y).alias("summary"))


def driver_and_proxies(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """A driver angle, its cosine and sine, an unrelated column and the outcome."""
    rows = spark.range(n).select("id", (F.rand(seed) * 6.283185307179586).alias("driver"), F.randn(seed + 1).alias("unrelated"), F.randn(seed + 2).alias("_e"))
    return rows.select("id", "driver", F.cos("driver").alias("proxy_cos"), F.sin("driver").alias("proxy_sin"), "unrelated", (F.cos("driver") + 0.1 * F.col("_e")).alias("y"))


def trial(spark: SparkSession, n: int, seed: int, effect: float = 1.0) -> DataFrame:
    """A randomised trial: a latent modifier, markers of falling quality, treatment and outcome."""
    rows = spark.range(n).select("id", F.randn(seed).alias("_latent"), (40 + 15 * F.randn(seed + 1)).alias("age"), (F.rand(seed + 2) < 0.5).cast("int").alias("sex"), (F.rand(seed + 3) < 0.5).cast("int").alias("treatment"), *(F.randn(seed + 4 + k).alias(f"_e{k}") for k in range(8)))
    marker = lambda k, noise: F.col("_latent") + noise * F.col(f"_e{k}")
    outcome = effect * F.col("treatment") * (1 + F.col("_latent")) + 0.02 * F.col("age") + F.col("_e7")
    return rows.select("id", "age", "sex", marker(0, 0.2).alias("biopsy_marker"), marker(1, 0.8).alias("blood_marker_a"), marker(2, 1.2).alias("blood_marker_b"), marker(3, 1.5).alias("imaging_score"), F.col("_e4").alias("batch_artifact"), F.col("_e5").alias("noise_1"), F.col("_e6").alias("noise_2"), (F.col("_latent") + F.col("_e5")).alias("symptom_score"), "treatment", outcome.alias("outcome"))


def noisy_pairs(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pair, x, y): a cubic cause, its reverse, and an independent pair."""
    rows = spark.range(n).select((2 * F.rand(seed) - 1).alias("a"), (2 * F.rand(seed + 1) - 1).alias("e"), F.randn(seed + 2).alias("b"))
    effect = 2 * F.col("a") * F.col("a") * F.col("a") + F.col("a") + 0.4 * F.col("e")
    kinds = F.array(F.struct(F.lit("forward").alias("pair"), F.col("a").alias("x"), effect.alias("y")), F.struct(F.lit("backward").alias("pair"), effect.alias("x"), F.col("a").alias("y")), F.struct(F.lit("independent").alias("pair"), F.col("a").alias("x"), F.col("b").alias("y")))
    return rows.select(F.explode(kinds).alias("k")).select("k.*")


def chain_fork_triples(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(system, t, a, b, c) of a chain a>b>c, a fork a>b, a>c, and three independent maps."""

    def run(frames):
        for frame in frames:
            for k, name in zip(frame["k"], frame["name"]):
                rng, strength = np.random.default_rng([seed, k]), 0.4
                s, out = rng.uniform(0.2, 0.8, 3), np.empty((n + 100, 3))
                for i in range(n + 100):
                    out[i] = s
                    own = np.array([3.8, 3.7, 3.75]) * s * (1 - s)
                    if name != "independent":
                        own[1] = (1 - strength) * own[1] + strength * s[0]
                        own[2] = (1 - strength) * own[2] + strength * s[1 if name == "chain" else 0]
                    s = np.clip(own, 1e-6, 1 - 1e-6)
                yield pd.DataFrame({"system": name, "t": np.arange(n), "a": out[100:, 0], "b": out[100:, 1], "c": out[100:, 2]})

    return spark.createDataFrame([(0, "chain"), (1, "fork"), (2, "independent")], "k int, name string").mapInPandas(run, "system string, t long, a double, b double, c double")

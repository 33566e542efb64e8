"""State-space operators: simplex projection, cross mapping, surrogates and the direction tests built on them.

A task is one (pair, direction, library size, replicate); the series of a pair travels with its tasks, so tasks are independent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delay_embed(x: np.ndarray, dimension: int, delay: int) -> tuple[np.ndarray, np.ndarray]:
    """(delay vectors, present value first; their times)."""
    if dimension < 1 or delay < 1:
        raise ValueError("dimension and delay start at 1")
    x = np.asarray(x, float)
    first = (dimension - 1) * delay
    if len(x) <= first:
        raise ValueError("the series is too short for this embedding")
    times = np.arange(first, len(x))
    return np.stack([x[times - k * delay] for k in range(dimension)], axis=1), times


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 3 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return float("nan")
    return float(np.corrcoef(a, b)[0, 1])


def simplex_predict(library: np.ndarray, library_times: np.ndarray, values: np.ndarray, points: np.ndarray, times: np.ndarray, radius: int = 0, weighting: str = "simplex", k: int | None = None) -> np.ndarray:
    """Predictions at `points` from the nearest library vectors further than `radius` in time; nan where too few are left."""
    k = library.shape[1] + 1 if k is None else k
    out = np.full(len(points), np.nan)
    for start in range(0, len(points), 512):
        own = points[start : start + 512]
        d = np.sqrt(np.maximum(((own[:, None] - library[None]) ** 2).sum(-1), 0))
        d[np.abs(times[start : start + 512, None] - library_times[None]) <= radius] = np.inf
        if d.shape[1] < k:
            continue
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, order, 1)
        good = np.isfinite(near).all(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            weight = np.maximum(np.exp(-near / near[:, :1]), 1e-6) if weighting == "simplex" else np.ones_like(near)
        zero = near[:, 0] == 0
        weight[zero] = np.maximum((near[zero] == 0).astype(float), 1e-6)
        out[start : start + 512][good] = ((weight * values[order]).sum(1) / weight.sum(1))[good]
    return out


def softmax_predict(library: np.ndarray, library_times: np.ndarray, values: np.ndarray, points: np.ndarray, times: np.ndarray, beta: float, radius: int = 0, kernel: str = "dist") -> np.ndarray:
    """Retrieval with weights softmax(beta * similarity), similarity a dot product or a negative squared distance."""
    s = points @ library.T if kernel == "dot" else -((points[:, None] - library[None]) ** 2).sum(-1)
    s = beta * s
    s[np.abs(times[:, None] - library_times[None]) <= radius] = -np.inf
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return (s @ values) / s.sum(axis=1)


def cross_map(effect: np.ndarray, cause: np.ndarray, dimension: int, delay: int, radius: int = 0, size: int | None = None, seed: int = 0) -> float:
    """Skill with which the effect's manifold gives back the cause; a library of `size` vectors is drawn without replacement."""
    manifold, times = delay_embed(effect, dimension, delay)
    chosen = np.arange(len(manifold))
    if size is not None and size < len(chosen):
        chosen = np.sort(np.random.default_rng(seed).permutation(len(chosen))[:size])
    seen = simplex_predict(manifold[chosen], times[chosen], cause[times[chosen]], manifold, times, radius)
    good = np.isfinite(seen)
    return pearson(seen[good], cause[times][good])


def library_sizes(n: int, dimension: int, count: int = 8) -> list[int]:
    """Sizes in geometric steps from max(dimension + 2, 10) to n."""
    low = min(max(dimension + 2, 10), n)
    return sorted({int(round(x)) for x in np.geomspace(low, n, count)})


def seed_of(*parts) -> int:
    return int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:4], "little")


def phase_surrogate(x: np.ndarray, seed: int) -> np.ndarray:
    """A series with the same spectrum and random phases; the mean stays, the highest frequency of an even length keeps a real sign."""
    rng, n = np.random.default_rng(seed), len(x)
    spectrum = np.fft.rfft(x)
    turn = np.exp(1j * rng.uniform(0, 2 * np.pi, len(spectrum)))
    turn[0] = 1
    if n % 2 == 0:
        turn[-1] = rng.choice([-1, 1])
    return np.fft.irfft(spectrum * turn, n)


def shift_surrogate(x: np.ndarray, seed: int) -> np.ndarray:
    return np.roll(x, np.random.default_rng(seed).integers(1, len(x)))


def optimal_dimension(x: np.ndarray, most: int = 6, delay: int = 1, ahead: int = 1) -> int:
    """The smallest dimension with the best forecast skill, over the points that all dimensions can predict."""
    best, chosen, first = -np.inf, 1, (most - 1) * delay
    for dimension in range(1, most + 1):
        manifold, times = delay_embed(x, dimension, delay)
        keep = (times >= first) & (times + ahead < len(x))
        manifold, times = manifold[keep], times[keep]
        seen = simplex_predict(manifold, times, x[times + ahead], manifold, times)
        good = np.isfinite(seen)
        skill = pearson(seen[good], x[times + ahead][good])
        if skill > best:
            best, chosen = skill, dimension
    return chosen


def convergent_cross_mapping(series: DataFrame, dimension: int = 3, delay: int = 1, replicates: int = 8, radius: int = 0, seed: int = 0, sizes: list[int] | None = None) -> DataFrame:
    """(system, cause, effect, size, rep, rho) for both directions of each system; series: (system, t, x, y).

    x causes y if y's manifold gives back x, so `rho` of cause x and effect y is the skill of y's manifold. The whole library
    is mapped once.
    """

    def tasks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        n = len(frame) - (dimension - 1) * delay
        grid = [(s, r) for s in (sizes or library_sizes(n, dimension)) for r in range(replicates if s < n else 1)]
        x, y, name = frame["x"].to_numpy(), frame["y"].to_numpy(), frame["system"].iloc[0]
        return pd.DataFrame([(name, c, e, s, r, x, y) for c, e in (("x", "y"), ("y", "x")) for s, r in grid], columns=["system", "cause", "effect", "size", "rep", "x", "y"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.itertuples():
            cause, effect = (r.x, r.y) if r.cause == "x" else (r.y, r.x)
            out.append(cross_map(np.asarray(effect), np.asarray(cause), dimension, delay, radius, r.size, seed_of(seed, r.size, r.rep)))
        return frame[["system", "cause", "effect", "size", "rep"]].assign(rho=out)

    grid = series.groupBy("system").applyInPandas(tasks, "system string, cause string, effect string, size long, rep long, x array<double>, y array<double>")
    return grid.groupBy("system", "cause", "size", "rep").applyInPandas(run, "system string, cause string, effect string, size long, rep long, rho double")


def convergence(samples: DataFrame, least_rho: float = 0.3, least_gain: float = 0.05, alpha: float = 0.025) -> DataFrame:
    """(system, cause, effect, rho, gain, low, converges): skill at the largest library, its gain over the smallest, and the low end of replicates' gains."""
    by = ["system", "cause", "effect"]
    ends = samples.groupBy(*by).agg(F.min("size").alias("small"), F.max("size").alias("large"))
    joined = samples.join(ends, by)
    top = joined.where("size = large").groupBy(*by).agg(F.avg("rho").alias("top"))
    deltas = joined.where("size = small").join(top, by).select(*by, "top", (F.col("top") - F.col("rho")).alias("d"))
    out = deltas.groupBy(*by).agg(F.first("top").alias("rho"), F.avg("d").alias("gain"), F.percentile("d", F.lit(alpha)).alias("low"))
    return out.withColumn("converges", F.coalesce((F.col("rho") >= least_rho) & (F.col("gain") >= least_gain) & (F.col("low") > 0), F.lit(False)))


def dominant_direction(verdicts: DataFrame) -> DataFrame:
    """(system, dominant cause) among the converging directions; null if none does."""
    return verdicts.groupBy("system").agg(F.max_by("cause", F.when(F.col("converges"), F.col("rho"))).alias("best"), F.bool_or("converges").alias("_any")).select("system", F.when(F.col("_any"), F.col("best")).alias("dominant"))


def surrogate_test(series: DataFrame, draws: int = 49, method: str = "phase", dimension: int = 3, delay: int = 1, seed: int = 0) -> DataFrame:
    """(system, cause, rho, p) against nulls with a randomised cause; an undefined skill has p = 1, an undefined null counts against."""
    make = {"phase": phase_surrogate, "shift": shift_surrogate}[method]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        out, name = [], frame["system"].iloc[0]
        for cause, effect in (("x", "y"), ("y", "x")):
            c, e = frame[cause].to_numpy(), frame[effect].to_numpy()
            rho = cross_map(e, c, dimension, delay)
            null = np.array([cross_map(e, make(c, seed_of(seed, cause, k)), dimension, delay) for k in range(draws)])
            p = 1.0 if np.isnan(rho) else (1 + (np.isnan(null) | (null >= rho)).sum()) / (draws + 1)
            out.append((name, cause, rho, float(p)))
        return pd.DataFrame(out, columns=["system", "cause", "rho", "p"])

    return series.groupBy("system").applyInPandas(run, "system string, cause string, rho double, p double")

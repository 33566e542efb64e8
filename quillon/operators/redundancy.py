"""Redundancy and attribution: predictability linear from sums, binned or by forests, Shapley values from a value table, forests from Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb, factorial

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settled


def moments(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, covariance) of a few columns by one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    clean = df.dropna(subset=columns)
    row = clean.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), cov


def linear_r2(cov: np.ndarray, target: int, others: list[int]) -> float:
    """R2 of a column's least-squares fit on others, from the covariance."""
    if not others or cov[target, target] <= 0:
        return 0.0
    spread = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1))
    corr = cov / np.outer(spread, spread)
    weights = np.linalg.lstsq(corr[np.ix_(others, others)], corr[others, target], rcond=1e-10)[0]
    return float(np.clip(corr[others, target] @ weights, 0, 1))


def scorer(df: DataFrame, columns: list[str], trees: int = 0) -> Callable[[str, list[str]], float]:
    """f(target, others) = R2: least squares on one pass of sums, or with `trees` a cross-validated forest for each call."""
    if trees:
        return lambda target, others: forest_r2(df, target, others, trees=trees)
    _, _, cov = moments(df, columns)
    return lambda target, others: linear_r2(cov, columns.index(target), [columns.index(c) for c in others])


def verdict(r2: Column, threshold: float = 0.95, partial: float = 0.5) -> Column:
    return F.when(r2 >= threshold, "redundant").when(r2 >= partial, "partially redundant").otherwise("unique")


def redundancy_scores(df: DataFrame, columns: list[str], threshold: float = 0.95, partial: float = 0.5, trees: int = 0) -> DataFrame:
    """(feature, r2_from_others, redundant, verdict); with `trees` by forests, which also see nonlinear copies."""
    r2 = scorer(df, columns, trees)
    rows = [(c, r2(c, [o for o in columns if o != c])) for c in columns]
    out = df.sparkSession.createDataFrame(rows, "feature string, r2_from_others double")
    return out.select("*", (F.col("r2_from_others") >= threshold).alias("redundant"), verdict(F.col("r2_from_others"), threshold, partial).alias("verdict"))


def pairwise_r2(df: DataFrame, columns: list[str], bins: int = 32) -> DataFrame:
    """(predictor, target, r2) of all ordered pairs: the share of the target's variance between the predictor's bins of equal width.

    Nonlinear, so the two directions differ; in-sample, so some bins/rows too large. Rows with a null are left out; a constant target has null.
    """
    clean = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    ends = clean.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in columns))
    place = lambda c: F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"_{c}.lo"), F.col(f"_{c}.hi") - F.col(f"_{c}.lo")) * bins), F.lit(0)), F.lit(bins - 1))
    # A row goes once to each predictor's bin, which sums up all targets.
    bins_of = [F.struct(F.lit(a).alias("predictor"), place(a).alias("bin")) for a in columns]
    placed = clean.join(F.broadcast(ends)).select(F.explode(F.array(*bins_of)).alias("p"), *columns).select("p.*", *columns)
    sums = placed.groupBy("predictor", "bin").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.var_pop))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("target"), F.col(f"m{i}").alias("m"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns))))
    cells = sums.select("predictor", "bin", "n", each.alias("t")).select("predictor", "bin", "n", "t.*").where("predictor <> target")
    cells = settled(cells)  # columns squared times bins; both sums below and whoever joins the result read it
    sums = cells.groupBy("predictor", "target").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("inner"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    outer = cells.join(F.broadcast(sums.select("predictor", "target", "mean")), ["predictor", "target"]).groupBy("predictor", "target").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("outer"))
    return sums.join(outer, ["predictor", "target"]).select("predictor", "target", F.try_divide("outer", F.col("outer") + F.col("inner")).alias("r2"))


#: Depth up to which trees grow; they stop earlier at five rows a leaf. Every split sees all columns.
FOREST_DEPTH = 12
#: Rows of a forest's task: they are few bytes and much work, so the files' sizes mustn't decide how many tasks there are.
FOREST_ROWS = 1 << 15


def forest_rows(df: DataFrame) -> DataFrame:
    """df in a task for each FOREST_ROWS rows, or as it is if that many tasks or more read it."""
    tasks = df.count() // FOREST_ROWS + 1
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def forest_r2(df: DataFrame, target: str, columns: list[str], folds: int = 3, trees: int = 120, seed: int = 0) -> float:
    """Cross-validated R2 of a random forest; folds by hash; 0 without columns or spread."""
    if not columns:
        return 0.0
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(forest_rows(df.dropna(subset=[target, *columns]))).withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), *columns, target), F.lit(folds)))
    error, weight = 0.0, 0
    for fold in range(folds):
        model = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=FOREST_DEPTH, featureSubsetStrategy="all", minInstancesPerNode=5, seed=seed).fit(rows.where(F.col("_f") != fold))
        row = model.transform(rows.where(F.col("_f") == fold)).agg(F.sum((F.col(target) - F.col("prediction")) ** 2).alias("e"), F.count(F.lit(1)).alias("n")).first()
        error, weight = error + (row["e"] or 0.0), weight + row["n"]
    spread = rows.agg(F.var_pop(target)).first()[0] or 0.0
    return max(0.0, 1 - error / weight / spread) if spread > 0 and weight else 0.0


def equivalence_links(scores: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) of features that predict each other: pairs of (i, j, score) with both directions at the threshold."""
    good = scores.where(F.col("score") >= threshold)
    return good.select(F.col("i").alias("src"), F.col("j").alias("dst")).join(good.select(F.col("j").alias("src"), F.col("i").alias("dst")), ["src", "dst"]).where("src < dst")


def coalition_values(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(mask, value): linear R2 of the target on each coalition of columns; 2^d rows."""
    if len(columns) > 10:
        raise ValueError("exact coalitions go up to ten columns")
    _, _, cov = moments(df, [target, *columns])
    rows = [(mask, linear_r2(cov, 0, [i + 1 for i in range(len(columns)) if mask >> i & 1])) for mask in range(1 << len(columns))]
    return df.sparkSession.createDataFrame(rows, "mask long, value double")


def shapley(values: DataFrame, features: list[str]) -> DataFrame:
    """(feature, shapley) from a value table: each coalition without a feature joined with the one that has it."""
    d = len(features)
    names = values.sparkSession.createDataFrame([(j, 1 << j, f) for j, f in enumerate(features)], "j int, bit long, feature string")
    weights = values.sparkSession.createDataFrame([(s, factorial(s) * factorial(d - s - 1) / factorial(d)) for s in range(d)], "s int, w double")
    without = values.join(F.broadcast(names), F.col("mask").bitwiseAND(F.col("bit")) == 0).select("feature", "value", F.col("mask").bitwiseOR(F.col("bit")).alias("with"), F.bit_count("mask").alias("s"))
    joined = without.join(values.select(F.col("mask").alias("with"), F.col("value").alias("v2")), "with").join(F.broadcast(weights), "s")
    return joined.groupBy("feature").agg(F.sum(F.col("w") * (F.col("v2") - F.col("value"))).alias("shapley"))


def sampled_shapley(values: dict[int, float], d: int, permutations: int, seed: int) -> np.ndarray:
    """Shapley values from random orders, for more features than exact coalitions allow."""
    rng, out = np.random.default_rng(seed), np.zeros(d)
    for _ in range(permutations):
        mask = 0
        for j in rng.permutation(d):
            out[j] += values[mask | 1 << int(j)] - values[mask]
            mask |= 1 << int(j)
    return out / permutations


def leave_one_out(df: DataFrame, target: str, columns: list[str], trees: int = 0) -> DataFrame:
    """(feature, loss): R2 lost without each column."""
    r2 = scorer(df, [target, *columns], trees)
    full = r2(target, columns)
    rows = [(c, full - r2(target, [o for o in columns if o != c])) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, loss double")


def noise_floor(df: DataFrame, target: str, columns: list[str], nulls: int = 2, seed: int = 0) -> float:
    """The largest absolute Shapley value that columns of hash-drawn noise get: values below it say nothing."""
    names = [f"_null{k}" for k in range(nulls)]
    noise = {n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), target, *columns), F.lit(1 << 20)) / float(1 << 20) for n in names}
    every = [*columns, *names]
    values = shapley(coalition_values(df.select(target, *columns).withColumns(noise), target, every), every)
    return float(values.where(F.col("feature").isin(names)).agg(F.max(F.abs("shapley"))).first()[0])


def minimal_removals(df: DataFrame, target: str, columns: list[str], keep: float, evaluations: int = 300, beam: int = 8, trees: int = 0) -> list[str]:
    """The fewest columns whose removal leaves less than `keep` of the full R2, the most harmful ones of that size; all if nothing less does.

    Sizes rise. While a size's subsets fit into what is left of `evaluations`, all of them are tried, so the answer is minimal;
    from the first size that doesn't fit on, the `beam` most harmful subsets of the size before grow by one column each.
    """
    r2 = scorer(df, [target, *columns], trees)
    full, front = r2(target, columns), [frozenset()]
    for size in range(1, len(columns)):
        if comb(len(columns), size) <= evaluations:
            tried = [frozenset(c) for c in combinations(columns, size)]
            evaluations -= len(tried)
        else:
            evaluations = 0
            tried = list({s | {c} for s in front[:beam] for c in columns if c not in s})
        scored = sorted(((r2(target, [c for c in columns if c not in s]), sorted(s), s) for s in tried), key=lambda x: x[:2])
        if scored[0][0] < keep * full:
            return scored[0][1]
        front = [s for _, _, s in scored]
    return sorted(columns)

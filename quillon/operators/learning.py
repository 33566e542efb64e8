"""Learners and probes: ridge panels, neighbour regression, forests, shares of several methods, network statistics."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import min_rank
from ..functions.stats import auroc
from ..storage import settled
from .relational import shares


def grouped_ridge(df: DataFrame, by: str, x: list[str], y: list[str], train: str, alpha: float = 1.0, intercept: bool = False, ddof: int = 1) -> DataFrame:
    """(by, r2): held-out R2 of one ridge fit a group, averaged over targets and floored at 0; nan with under two rows of either part.

    Groups stay distributed: Gram matrices are sums, only a group's one row of sums meets Python, and errors are sums again.
    """
    rows = df.select(F.col(by).alias("g"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)), *(F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(y)), F.col(train).alias("t")).dropna()
    names = [*(f"x{i}" for i in range(len(x))), *(f"y{i}" for i in range(len(y)))]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(names))]
    sums = rows.where("t").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c) for c in names)).alias("mean"), F.array(*(F.covar_pop(names[i], names[j]) for i, j in cells)).alias("cov"))

    def solve(frames):
        for f in frames:
            weights = []
            for n, mean, cov in zip(f["n"], f["mean"], f["cov"]):
                gram = np.zeros((len(x), len(names)))
                for (i, j), c in zip(cells, cov):
                    gram[i, j] = n * (c + (0 if intercept else mean[i] * mean[j]))
                    if j < len(x):
                        gram[j, i] = gram[i, j]
                weights.append(np.linalg.solve(gram[:, : len(x)] + alpha * np.eye(len(x)), gram[:, len(x) :]).T.ravel())
            yield pd.DataFrame({"g": f["g"], "n": f["n"], "mean": f["mean"], "weights": weights})

    kind = dict(df.dtypes)[by]
    fits = sums.mapInPandas(solve, f"g {kind}, n long, mean array<double>, weights array<double>")
    level = lambda i: F.col("mean")[i] if intercept else F.lit(0.0)
    guess = lambda k: sum(((F.col(f"x{i}") - level(i)) * F.col("weights")[k * len(x) + i] for i in range(len(x))), level(len(x) + k))
    held = rows.where(~F.col("t")).join(fits.where("n > 1"), "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col(f"y{k}") - guess(k)) ** 2).alias(f"e{k}") for k in range(len(y))), *((F.var_samp if ddof else F.var_pop)(f"y{k}").alias(f"s{k}") for k in range(len(y))))
    each = [F.when(F.col(f"s{k}") > 0, F.greatest(F.lit(0.0), 1 - F.col(f"e{k}") / F.col(f"s{k}"))).otherwise(0.0) for k in range(len(y))]
    scores = held.where("n > 1").select("g", (sum(each[1:], each[0]) / len(y)).alias("r2"))
    return rows.select("g").distinct().join(scores, "g", "left").select(F.col("g").alias(by), F.coalesce("r2", F.lit(float("nan"))).alias("r2"))


#: Entities of a group of panels.
PANELS = 2048


def panel_ridge(df: DataFrame, partners: DataFrame, key: str, vector: str, alpha: float = 1.0) -> DataFrame:
    """(key, r2): in-sample R2, held in [0, 1], of each entity's centred vector by ridge on those of its partners (key, partner); 0 if constant.

    A group holds the partners of about PANELS entities; vectors travel once for each pair.
    """
    vectors = df.select(F.col(key).cast("long").alias("partner"), F.col(vector).cast("array<double>").alias("v"))
    pairs = partners.select("key", "partner").unionByName(partners.select("key").distinct().withColumn("partner", F.col("key")))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(other=frame["partner"] != frame["key"]).sort_values(["key", "other", "partner"])
        v, keys = np.stack(frame["v"]), frame["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        v = v - v.mean(1, keepdims=True)
        sizes, r2 = np.diff(np.append(starts, len(v))), np.zeros(len(starts))
        for size in np.unique(sizes):  # entities of equally many partners at once
            of = np.flatnonzero(sizes == size)
            m = v[starts[of, None] + np.arange(size)]
            x, y = m[:, 1:], m[:, 0]
            w = np.linalg.solve(x @ x.transpose(0, 2, 1) + alpha * np.eye(size - 1), x @ y[:, :, None])
            rest, total = y - (w.transpose(0, 2, 1) @ x)[:, 0], (y**2).sum(1)
            r2[of] = np.where(total > 0, np.clip(1 - (rest**2).sum(1) / np.where(total > 0, total, 1), 0, 1), 0.0)
        return pd.DataFrame({"key": keys[starts], "r2": r2})

    cells = F.pmod(F.xxhash64("key"), F.lit(df.count() // PANELS + 1)).alias("cell")
    return pairs.join(vectors, "partner").groupBy(cells).applyInPandas(fit, "key long, r2 double")


def neighbour_regression(points: np.ndarray, values: np.ndarray, queries: np.ndarray, k: int = 5, weighted: bool = False) -> np.ndarray:
    """Mean (or distance-weighted mean) value of the k nearest points of each query."""
    d = np.sqrt(np.maximum(((queries[:, None] - points[None]) ** 2).sum(-1), 0))
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    w = 1 / np.maximum(np.take_along_axis(d, order, 1), 1e-12) if weighted else np.ones(order.shape)
    return (w * values[order]).sum(1) / w.sum(1)


def component_r2(x: np.ndarray, ranks: list[int]) -> dict[int, float]:
    """R2 of reconstructions from the first components, over all columns together."""
    centred = x - x.mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    total = (centred**2).sum()
    return {r: float(1 - ((centred - (u[:, :r] * s[:r]) @ v[:r]) ** 2).sum() / total) if total else 0.0 for r in ranks}


def knee(scores: dict[int, float], threshold: float) -> int | None:
    """The smallest rank whose score reaches the threshold."""
    return min((r for r, s in scores.items() if s >= threshold), default=None)


def participation(spectrum: np.ndarray) -> tuple[float, int]:
    """(participation ratio, components for 95 per cent) of a spectrum."""
    s = np.sort(np.maximum(spectrum, 0))[::-1]
    total = s.sum()
    return (float(total**2 / (s**2).sum()), int(np.searchsorted(np.cumsum(s) / total, 0.95 - 1e-12) + 1)) if total else (0.0, 0)


def _assembled(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    rows = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.dropna(subset=[*columns, label]))
    rows = rows.withColumn("_y", F.col(label).cast("double"))
    sums = rows.groupBy("_y").agg(F.count(F.lit(1)).alias("_c"))
    total = sums.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weights = settled(sums.join(F.broadcast(total)).select(F.col("_y").alias("_yy"), (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("_w")))  # every fit reads them
    rows = rows.join(F.broadcast(weights), F.col("_y") == F.col("_yy"))
    return StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows).transform(rows)


def baseline_importances(df: DataFrame, columns: list[str], label: str, trees: int = 50, c: float = 1.0, seed: int = 0) -> DataFrame:
    """(method, feature, value): absolute l1 logistic weights, forest importances, |AUC - 0.5| and held-out permutation costs."""
    spark = df.sparkSession
    rows = _assembled(df.select(*columns, label), columns, label).withColumn("_test", F.pmod(F.xxhash64(F.lit(seed), *columns, label), F.lit(5)) == 0)
    train = rows.where(~F.col("_test"))
    n = max(train.count(), 1)
    logistic = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", elasticNetParam=1.0, regParam=1 / (c * n)).fit(train)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, seed=seed).fit(train)
    out = [("l1", f, float(v)) for f, v in zip(columns, np.abs(logistic.coefficientMatrix.toArray()).mean(0))]
    out += [("forest", f, float(v)) for f, v in zip(columns, forest.featureImportances.toArray())]
    for f in columns:
        a = auroc(rows.select(F.col(f).cast("double").alias("s"), "_y"), "s", F.col("_y") > 0).first()["auroc"]
        out.append(("auc", f, abs((a if a is not None else 0.5) - 0.5)))
    out += permutation_costs(rows.where("_test"), forest, columns, seed)
    return spark.createDataFrame(out, "method string, feature string, value double")


def permutation_costs(test: DataFrame, model, columns: list[str], seed: int, groups: dict[str, list[str]] | None = None) -> list[tuple[str, str, float]]:
    """Accuracy lost on held-out rows when a column (or a group of columns together) is dealt anew by hash order; 0 at least."""
    test = settled(test.select("_y", *columns, F.xxhash64(F.lit(seed), *columns, "_y").alias("_id")))
    # Ranks inside hash cells pair each row with another of its cell, so no task orders all rows.
    count = test.count()
    if not count:
        return [("permutation", f, 0.0) for f in (groups or columns)]
    cell = F.pmod(F.col("_id"), F.lit(max(1, count // 10_000)))
    test = test.withColumn("_cell", cell)
    natural = settled(test.select("_cell", "_y", *columns, F.row_number().over(Window.partitionBy("_cell").orderBy("_id", *columns)).alias("_r")))
    assembler = VectorAssembler(inputCols=columns, outputCol="_x")
    score = lambda d: model.transform(assembler.transform(d)).agg(F.avg((F.col("prediction") == F.col("_y")).cast("int"))).first()[0] or 0.0
    plain, out = score(test), []
    for name, own in (groups or {f: [f] for f in columns}).items():
        mixed = test.select("_cell", *(F.col(c).alias(f"_m{c}") for c in own), F.row_number().over(Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 1), "_id"), *columns)).alias("_r"))
        swapped = natural.join(mixed, ["_cell", "_r"]).select("_y", *(F.col(f"_m{c}").alias(c) if c in own else F.col(c) for c in columns))
        out.append(("permutation", name, max(0.0, plain - score(swapped))))
    return out


def importance_shares(table: DataFrame) -> DataFrame:
    """(method, feature, share, rank) of (method, feature, value): shares of each method's total and minimum ranks."""
    return shares(table, ["method"], "value").select("method", "feature", "share", min_rank(["method"], "share", True).alias("rank"))


def group_losses(r2_of, groups: dict[str, list[str]]) -> list[tuple[str, float]]:
    """(group, R2 lost without all of its columns); r2_of takes a list of columns."""
    every = [c for cs in groups.values() for c in cs]
    full = r2_of(every)
    return [(g, full - r2_of([c for c in every if c not in cs])) for g, cs in groups.items()]


def macro_auroc(df: DataFrame, label: str, score: str) -> float | None:
    """Mean one-versus-rest AUROC over the classes of an integer score map (label -> score column prefix); None if a class lacks rows."""
    values = []
    for r in df.select(label).distinct().collect():
        a = auroc(df.select(F.element_at(score, F.lit(r[0])).alias("s"), (F.col(label) == r[0]).alias("p")), "s", F.col("p")).first()["auroc"]
        if a is None:
            return None
        values.append(a)
    return float(np.mean(values)) if values else None


def paired_z(deltas: DataFrame, by: str, control: Column, value: str) -> DataFrame:
    """(by, z): mean paired delta against the control arm's mean and sample spread."""
    null = deltas.where(control).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    means = deltas.where(~control).groupBy(by).agg(F.avg(value).alias("_v"))
    return means.join(F.broadcast(null)).select(by, F.try_divide(F.col("_v") - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))).alias("z"))


def neural_collapse(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(within, between, ratio): scatter of unit activations inside and between classes, from each class's sums."""
    means = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias(c) for c in columns), *(F.var_pop(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    overall = df.agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    inner = sum((F.col(f"_s{i}") for i in range(1, len(columns))), F.col("_s0"))
    outer = sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in columns)
    out = means.join(F.broadcast(overall)).agg((F.sum(F.col("_n") * inner) / F.sum("_n")).alias("within"), (F.sum(F.col("_n") * outer) / F.sum("_n")).alias("between"))
    return out.withColumn("ratio", F.try_divide("within", "between"))


def weight_statistics(weights: np.ndarray) -> dict[str, float]:
    """Compressed bits a weight, stable rank and spectral entropy of a weight matrix."""
    top = np.abs(weights).max() or 1.0
    code = np.round(weights / top * 127 + 128).astype(np.uint8)
    s = np.linalg.svd(weights, compute_uv=False)
    p = s**2 / (s**2).sum() if s.any() else np.ones(len(s)) / len(s)
    return {"bits": 8 * len(zlib.compress(code.tobytes(), 9)) / code.size, "stable_rank": float((s**2).sum() / (s[0] ** 2 or 1.0)), "spectral_entropy": float(-(p[p > 0] * np.log(p[p > 0])).sum())}


def associative_reconstruction(x: np.ndarray, beta: float = 1.0, kernel: str = "dot", with_self: bool = False) -> np.ndarray:
    """Each row rebuilt as a softmax-weighted mean of the rows, without itself unless asked for."""
    if kernel == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = u @ u.T
    else:
        s = x @ x.T if kernel == "dot" else -((x[:, None] - x[None]) ** 2).sum(-1)
    s = beta * s
    if not with_self:
        np.fill_diagonal(s, -np.inf)
    s = np.exp(s - s.max(1, keepdims=True))
    return (s @ x) / s.sum(1, keepdims=True)


def gain_table(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, other, marginal_gain, conditional_gain, verdict) of an error table (keys, source, other, kind, mse).

    kind: none, source, other, both. A source is direct if it helps beyond the other, indirect if only alone.
    """
    by = [*keys, "source", "other"]
    arm = lambda k: F.max(F.when(F.col("kind") == k, F.col("mse")))
    wide = errors.groupBy(*by).agg(*(arm(k).alias(k) for k in ("none", "source_only", "other_only", "both")))
    out = wide.withColumn("marginal_gain", F.col("none") - F.col("source_only")).withColumn("conditional_gain", F.col("other_only") - F.col("both"))
    verdict = F.when(F.col("conditional_gain") > 0, "direct").when(F.col("marginal_gain") > 0, "indirect").otherwise("none")
    return out.select(*by, "marginal_gain", "conditional_gain", verdict.alias("verdict"))


def energy_ablation(x: np.ndarray, beta: float = 1.0) -> np.ndarray:
    """Mean rise of the retrieval energy -logsumexp(beta <row, others>) / beta when each column is set to 0 in the query."""

    def energy(q: np.ndarray) -> np.ndarray:
        s = beta * (q @ x.T)
        np.fill_diagonal(s, -np.inf)
        top = s.max(axis=1)
        return -(top + np.log(np.exp(s - top[:, None]).sum(axis=1))) / beta

    base, out = energy(x), np.empty(x.shape[1])
    for j in range(x.shape[1]):
        q = x.copy()
        q[:, j] = 0
        out[j] = (energy(q) - base).mean()
    return out


def partial_correlations(cov: np.ndarray) -> np.ndarray:
    """Correlations of each two columns given all others."""
    precision = np.linalg.pinv(cov)
    scale = np.sqrt(np.maximum(np.diag(precision), 1e-300))
    out = -precision / np.outer(scale, scale)
    np.fill_diagonal(out, 1.0)
    return out

"""Prediction by retrieval from a memory, with any set of the sources visible, and how well a query's energy foretells its error.

A set hides the other sources as if they were 0 in every row, so all sets ask the same rows. A block of queries meets a block of memories once:
each source gives its squared distances there, and a set's are the sum of its sources'.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_counts
from ..functions.stats import correlation
from .blocks import rough_gaps
from .pairs import BLOCK, block_count, dealt, nearest


def _faced(queries: DataFrame, memories: DataFrame, block: int) -> DataFrame:
    """(q_blk, p_blk, side, ...): queries (side 0) and memories (side 1) dealt to all pairs of their blocks."""
    asks, held = block_count(queries.count(), block), block_count(memories.count(), block)
    blk = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(blk(asks).alias("q_blk"), every(held).alias("p_blk"), F.lit(0).alias("side"), "*")
    right = memories.select(every(asks).alias("q_blk"), blk(held).alias("p_blk"), F.lit(1).alias("side"), "*")
    return dealt(left.unionByName(right), asks * held, "q_blk", "p_blk")


def _sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return tuple(frame[frame["side"] == s].sort_values("key") for s in (0, 1))


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _stacked(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    """One frame of parts; arrays are joined before they become columns, as strings in several chunks don't leave a task."""
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def conditional_retrieval(df: DataFrame, key: str, parts: dict[str, str], target: str, train: Column, sets: dict[str, list[str]], k: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, set, predicted, actual): for each row that isn't training data, the mean target of its k nearest training rows by each set's sources.

    `parts` names the sources and their array columns; `sets` names sources to be seen together (none: every memory is equally near).
    Neighbours weigh 1 / distance (those at distance 0, if any, alone), ties go to smaller keys, distances are compared at nine places
    of their squares. Keys are unique numbers; rows whose key, target, train or a source is null or non-finite take no part, and without
    training rows there is no prediction. A task holds two blocks; each sends k rows a query and set.
    """
    names = list(parts)
    rows = df.select(F.col(key).cast("long").alias("key"), F.array(*(F.col(c).cast("array<double>") for c in parts.values())).alias("x"), F.col(target).cast("double").alias("y"), train.alias("train"))
    rows = rows.where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf")) & F.col("train").isNotNull() & F.forall("x", _usable))
    places = [[names.index(c) for c in seen] for seen in sets.values()]

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        q, p = _sides(frame)
        if not len(q) or not len(p):
            return pd.DataFrame({c: [] for c in ("key", "set", "actual", "partner", "d2", "y")})
        a, b = ([np.stack([r[i] for r in f["x"]]) for i in range(len(names))] for f in (q, p))
        roughs = [rough_gaps(x, y) for x, y in zip(a, b)]
        out, keys, values, found = [], p["key"].to_numpy(), p["y"].to_numpy(), {}
        for s, seen in enumerate(places):
            sources = tuple(sorted(seen))
            if sources not in found:

                def rough(i: slice, j: slice, sources=sources) -> np.ndarray:
                    return sum((roughs[c][0](i, j) for c in sources), np.zeros((i.stop - i.start, j.stop - j.start), np.float32))

                def exact(i: np.ndarray, j: np.ndarray, sources=sources) -> np.ndarray:
                    return np.round(sum((((a[c][i] - b[c][j]) ** 2).sum(1) for c in sources), np.zeros(len(i))), 9)

                found[sources] = nearest(len(q), len(p), rough, exact, k, sum((roughs[c][1] for c in sources), 1e-8))
            row, column, d2 = found[sources]
            out.append({"key": q["key"].to_numpy()[row], "set": np.full(len(row), s), "actual": q["y"].to_numpy()[row], "partner": keys[column], "d2": d2, "y": values[column]})
        return _stacked(out)

    faced = _faced(rows.where(~F.col("train")), rows.where("train"), block)
    found = faced.groupBy("q_blk", "p_blk").applyInPandas(near, "key long, set int, actual double, partner long, d2 double, y double")
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("key", "set").orderBy("d2", "partner"))).where(F.col("_r") <= k)
    weight = 1 / F.sqrt("d2")
    same, far = F.col("d2") == 0, F.col("d2") > 0
    at = F.avg(F.when(same, F.col("y")))
    off = F.sum(F.when(far, weight * F.col("y"))) / F.sum(F.when(far, weight))
    made = best.groupBy("key", "set").agg(F.coalesce(at, off).alias("predicted"), F.first("actual").alias("actual"))
    return made.select(F.col("key").alias(key), F.element_at(F.array(*map(F.lit, sets)), F.col("set") + 1).alias("set"), "predicted", "actual")


def skill(predictions: DataFrame) -> DataFrame:
    """(set, n, mse, r2) of predictions; r2 is null where the actual values don't vary."""
    lost = (F.col("predicted") - F.col("actual")) ** 2
    return predictions.groupBy("set").agg(F.count("*").alias("n"), F.avg(lost).alias("mse"), (1 - F.try_divide(F.avg(lost), F.var_pop("actual"))).alias("r2"))


def gain_sets(own: str, sources: list[str]) -> dict[str, list[str]]:
    """The sets that `gains` compares: own alone, with each source, all, and all but each source."""
    others = [s for s in sources if s != own]
    return {"own": [own], "all": [own, *others]} | {f"+{s}": [own, s] for s in others} | {f"-{s}": [own, *(o for o in others if o != s)] for s in others}


def gains(scores: DataFrame, floor: float = 0.0) -> DataFrame:
    """(source, marginal, conditional, verdict) of the skill of gain_sets: how much a source lowers the error beside own alone, and beside all
    others. It is direct if it helps beside all others by more than the floor, indirect if only beside own, else none.
    """
    one = lambda name: F.max(F.when(F.col("set") == name, F.col("mse")))
    ends = scores.agg(one("own").alias("_own"), one("all").alias("_all"))
    sign, source = F.substring("set", 1, 1), F.expr("substring(set, 2)")
    each = scores.where(sign.isin("+", "-")).groupBy(source.alias("source")).agg(F.max(F.when(sign == "+", F.col("mse"))).alias("_with"), F.max(F.when(sign == "-", F.col("mse"))).alias("_without"))
    out = each.join(F.broadcast(ends)).select("source", (F.col("_own") - F.col("_with")).alias("marginal"), (F.col("_without") - F.col("_all")).alias("conditional"))  # ends: one row
    return out.withColumn("verdict", F.when(F.col("conditional") > floor, "direct").when(F.col("marginal") > floor, "indirect").otherwise("none"))


def energies(df: DataFrame, key: str, system: str, state: str, target: str, betas: list[float], radius: int = 0, block: int = BLOCK) -> DataFrame:
    """(system, key, kernel, beta, n, energy, nearest, error) of every row against its system's rows whose keys (times) are more than `radius` away.

    The similarity s is minus half the squared distance (kernel `distance`) or the product (`dot`). The prediction is the softmax(beta * s) mean
    of the memories' targets, error its absolute error; the energy is -log(mean(exp(beta * s))) / beta, high where nothing in memory is like
    the query; nearest is the distance to the closest memory. One visit of a block pair serves all kernels and betas. Rows with a null or
    non-finite part take no part; a row without memories has no row here.
    """
    rows = df.select(F.col(system).cast("string").alias("system"), F.col(key).cast("long").alias("key"), F.col(state).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    rows = rows.where(F.col("system").isNotNull() & F.col("key").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf")) & _usable(F.col("x")))

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        q, p = _sides(frame)
        if not len(q) or not len(p):
            return pd.DataFrame({"system": [""], "kernel": [""]} | {c: [0] for c in ("key", "beta", "y", "n", "top", "w", "v", "d2")})  # goes below, as n is 0
        a, b, t, u = np.stack(q["x"]), np.stack(p["x"]), q["key"].to_numpy(), p["key"].to_numpy()
        d2, far, out = _gaps(a, b), np.abs(t[:, None] - u[None]) > radius, []
        for kernel, like in (("distance", -d2 / 2), ("dot", a @ b.T)):
            for beta in betas:
                s = np.where(far, beta * like, -np.inf)
                top = s.max(axis=1)
                e = np.exp(s - np.where(np.isfinite(top), top, 0)[:, None])
                same = {"system": q["system"].to_numpy(object), "key": t, "kernel": np.full(len(t), kernel, object), "beta": np.full(len(t), float(beta)), "y": q["y"].to_numpy()}
                out.append(same | {"n": far.sum(1), "top": top, "w": e.sum(1), "v": e @ p["y"].to_numpy(), "d2": np.where(far, d2, np.inf).min(axis=1)})
        return _stacked(out)

    counts = rows.groupBy("system").agg((F.floor(F.count("*") / block) + 1).cast("int").alias("blocks"))
    placed = rows.join(counts, "system").withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("system", F.col("blk").alias("q_blk"), every.alias("p_blk"), F.lit(0).alias("side"), "key", "x", "y")
    right = placed.select("system", every.alias("q_blk"), F.col("blk").alias("p_blk"), F.lit(1).alias("side"), "key", "x", "y")
    cells = counts.agg(F.sum(F.col("blocks").cast("long") * F.col("blocks"))).first()[0] or 1
    faced = dealt(left.unionByName(right), cells, "system", "q_blk", "p_blk")
    parts = faced.groupBy("system", "q_blk", "p_blk").applyInPandas(met, "system string, key long, kernel string, beta double, y double, n long, top double, w double, v double, d2 double").where("n > 0")
    one = ["system", "key", "kernel", "beta"]
    scaled = parts.withColumn("most", F.max("top").over(Window.partitionBy(*one))).withColumn("by", F.exp(F.col("top") - F.col("most")))
    sums = scaled.groupBy(*one, "y", "most").agg(F.sum("n").alias("n"), F.sum(F.col("w") * F.col("by")).alias("w"), F.sum(F.col("v") * F.col("by")).alias("v"), F.sqrt(F.min("d2")).alias("nearest"))
    energy = -(F.col("most") + F.log("w") - F.log("n")) / F.col("beta")
    return sums.select(F.col("system").alias(system), F.col("key").alias(key), "kernel", "beta", "n", energy.alias("energy"), "nearest", F.abs(F.col("v") / F.col("w") - F.col("y")).alias("error"))


def rank_correlation(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, rho): Spearman's correlation over all rows of a group, tied values at their mean rank; null where a side is constant.

    No task ranks a whole group. Rows with a null take no part.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c, name in ((x, "_x"), (y, "_y")):
        ranks = running_counts(rows, c, {"_n": F.lit(1)}, by=by).select(*by, c, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
        rows = rows.join(ranks, [*by, c])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), correlation("_x", "_y").alias("rho"))

"""What each channel adds to recreating each other one, with a shifted ghost among the sources of every target.

All linear fits come from one pass over the data: Gram matrices of the states and ghosts over training and over test times, summed
in blocks of columns. The ridge inverse is formed once; for a target its own columns are taken out by a Schur complement, its
ghost's are added by bordering, and each source is dropped by another Schur complement, so nothing is refitted and no row is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled
from .manifold import seed_of

#: Columns of a block of the Gram matrix.
GRAM_BLOCK = 512


def summed_grams(wide: DataFrame, size: int, block: int = GRAM_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrices of x over rows with train and over the others; each task adds up its rows, Spark adds the blocks."""
    edges = list(range(0, size, block))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[bool, int, int], np.ndarray] = {}
        for f in frames:
            for part in (True, False):
                own = f.loc[f["train"] == part, "x"]
                if len(own):
                    x = np.stack(own)
                    for a in edges:
                        for b in edges[edges.index(a) :]:
                            key = (part, a, b)
                            g = x[:, a : a + block].T @ x[:, b : b + block]
                            total[key] = total[key] + g if key in total else g
        for (part, a, b), g in total.items():
            yield pd.DataFrame({"train": [part], "a": [a], "b": [b], "sums": [g.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        g = np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0)
        return frame.iloc[:1].assign(sums=[g.tobytes()])

    schema, out = "train boolean, a int, b int, sums binary", {True: np.zeros((size, size)), False: np.zeros((size, size))}
    for r in wide.select("train", "x").mapInPandas(run, schema).groupBy("train", "a", "b").applyInPandas(add, schema).toLocalIterator():
        g = np.frombuffer(r["sums"]).reshape(min(block, size - r["a"]), -1)
        out[r["train"]][r["a"] : r["a"] + g.shape[0], r["b"] : r["b"] + g.shape[1]] = g
        out[r["train"]][r["b"] : r["b"] + g.shape[1], r["a"] : r["a"] + g.shape[0]] = g.T
    return out[True], out[False]


def without(inverse: np.ndarray, keep: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """The inverse of a matrix less some rows and columns, from the inverse of the whole."""
    return inverse[np.ix_(keep, keep)] - inverse[np.ix_(keep, drop)] @ np.linalg.solve(inverse[np.ix_(drop, drop)], inverse[np.ix_(drop, keep)])


def bordered(inverse: np.ndarray, side: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The inverse of [[A, side], [side', corner]] from that of A."""
    moved = inverse @ side
    s = np.linalg.inv(corner - side.T @ moved)
    return np.block([[inverse + moved @ s @ moved.T, -moved @ s], [-s @ moved.T, s]])


def target_gains(u: int, groups: int, width: int, train: np.ndarray, test: np.ndarray, inverse: np.ndarray, alpha: float, moments: tuple[np.ndarray, np.ndarray, int]) -> tuple[float, float, np.ndarray]:
    """(R2 with all sources and the ghost, the ghost's gain, each source's gain) for target u; ghosts follow the states in the Gram matrices."""
    columns = np.arange(groups * width).reshape(groups, width)
    own, others = columns[u], np.delete(columns, u, axis=0)
    rest, ghost = others.ravel(), groups * width + columns[u]
    reduced = without(inverse, rest, own)
    all_ = np.concatenate([rest, ghost])
    full = bordered(reduced, train[np.ix_(rest, ghost)], train[np.ix_(ghost, ghost)] + alpha * np.eye(width))
    sums, squares, n = moments
    spread = squares[own].sum() / (n * width) - (sums[own].sum() / (n * width)) ** 2
    gram, cross, power = test[np.ix_(all_, all_)], test[np.ix_(all_, own)], np.trace(test[np.ix_(own, own)])

    def r2(weights: np.ndarray, at: np.ndarray) -> float:
        error = np.sum(weights * (gram[np.ix_(at, at)] @ weights)) - 2 * np.sum(weights * cross[at]) + power
        return max(0.0, 1 - error / (n * width) / (spread + 1e-12))

    weights, everything = full @ train[np.ix_(all_, own)], np.arange(len(all_))
    base, gains = r2(weights, everything), np.full(groups, np.nan)
    for g in range(groups):  # the last group of the features is the ghost
        drop = np.arange(g * width, (g + 1) * width)
        keep = np.delete(everything, drop)
        less = weights[keep] - full[np.ix_(keep, drop)] @ np.linalg.solve(full[np.ix_(drop, drop)], weights[drop])
        gains[g] = base - r2(less, keep)
    out = np.full(groups, np.nan)
    out[np.delete(np.arange(groups), u)] = gains[: groups - 1]
    return base, float(gains[groups - 1]), out


def donor_of(target: str, names: list[str], n: int, seed: int) -> tuple[str, int]:
    """The channel whose copy is a target's ghost, and by how many rows it is shifted (within the middle half)."""
    others = [c for c in names if c != target]
    return others[seed_of(seed, target) % len(others)], n // 4 + seed_of(seed, target, "shift") % max(1, n // 2)


def gain_matrix(rows: DataFrame, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(target, source, gain, full_r2, ghost_gain) for rows (channel, t, train, own) as scan.states() gives them.

    `own` is recreated from the other channels' `own` and a ghost: another channel's, shifted in a circle. full_r2 is the held-out R2, 0 at
    least, with all of them; gain and ghost_gain are what it loses without the source or ghost. Times at which a channel lacks are left
    out. Three channels at least. The Gram matrices (twice the inputs, squared) go to the tasks: the result is a matrix of channels too.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("channel").agg(F.count("*")).collect()}
    names = sorted(sizes)
    if len(names) < 3:
        raise ValueError("a gain matrix needs three channels at least")
    spark, times = rows.sparkSession, rows.groupBy("t").agg(F.count("*").alias("_n")).where(F.col("_n") == len(names)).select("t")
    rows = settled(rows.select("channel", "t", "train", "own").join(times, "t"))
    n = rows.where(F.col("channel") == names[0]).count()
    width = len(rows.select("own").first()[0]) if n else 1
    drawn = spark.createDataFrame([(c, *donor_of(c, names, n, seed)) for c in names], "target string, donor string, shift long")
    order = F.row_number().over(Window.partitionBy("channel").orderBy("t")) - 1
    placed = rows.withColumn("p", order)
    moved = placed.join(F.broadcast(drawn), F.col("channel") == F.col("donor")).select("target", F.pmod(F.col("p") + F.col("shift"), F.lit(max(n, 1))).alias("p"), "own")
    clock = placed.where(F.col("channel") == names[0]).select("p", "t", "train")
    ghosts = moved.join(clock, "p").select(F.concat(F.lit("1"), "target").alias("channel"), "t", "train", "own")
    both = rows.select(F.concat(F.lit("0"), "channel").alias("channel"), "t", "train", "own").unionByName(ghosts)  # states before ghosts, each by name
    wide = settled(both.groupBy("t").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", "own"))), lambda s: s["own"])).alias("x"), F.bool_and("train").alias("train")))
    size = 2 * len(names) * width
    train, test = summed_grams(wide, size)
    states = len(names) * width
    held = wide.where(~F.col("train")).select(F.posexplode(F.slice("x", 1, states)).alias("c", "v")).groupBy("c").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    sums = np.zeros(states)
    for r in held:
        sums[r["c"]] = r["s"]
    moments = (sums, np.diag(test)[:states], held[0]["n"] if held else 1)
    inverse = np.linalg.inv(train[:states, :states] + alpha * np.eye(states))
    shared = spark.sparkContext.broadcast((train, test, inverse, moments))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train, test, inverse, moments = shared.value
        for f in frames:
            for u in f["u"]:
                base, ghost, out = target_gains(int(u), len(names), width, train, test, inverse, alpha, moments)
                yield pd.DataFrame({"target": names[u], "source": names, "gain": out, "full_r2": base, "ghost_gain": ghost}).drop(index=u)

    return spark.range(0, len(names), 1, min(len(names), 1000)).withColumnRenamed("id", "u").mapInPandas(run, "target string, source string, gain double, full_r2 double, ghost_gain double")

"""What columns tell a family of predictors about a target, on held-out rows, for every coalition of the columns.

A coalition's value is minus the family's mean held-out log loss (nats). No coalition is fitted from the rows: the family of tables adds up one
table of counts over its coarser groupings, the linear family solves parts of one pair of Gram matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .redundancy import shapley

#: Coalitions double with each column; beyond this the value table itself is the bottleneck.
MOST_COLUMNS = 20


def _bounded(columns: list[str]) -> int:
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"exact coalitions go up to {MOST_COLUMNS} columns")
    return len(columns)


def table_values(df: DataFrame, target: str, columns: list[str], held: Column, alpha: float = 1.0) -> DataFrame:
    """(mask, value) for predictors that look up the target's frequencies among training rows that are equal in the coalition's columns.

    A looked-up frequency is (count + alpha * prior) / (rows + alpha), the prior the target's own add-one frequency, so a combination unseen
    in training predicts the prior. A null in a column is a value of its own; rows without a target or with an undefined `held` take no part.
    Without held-out rows there is no value. The rows are counted once; the cells, not the rows, are copied for the coalitions.
    """
    d = _bounded(columns)
    rows = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(target).alias("y"), held.alias("h")).where(F.col("y").isNotNull() & F.col("h").isNotNull())
    names = [f"c{i}" for i in range(d)]
    cells = rows.groupBy(*names, "y").agg(F.count_if(~F.col("h")).alias("n"), F.count_if("h").alias("m"))
    classes = cells.groupBy("y").agg(F.sum("n").alias("_n"))
    size = classes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    prior = classes.join(F.broadcast(size)).select("y", ((F.col("_n") + 1) / (F.col("_all") + F.col("_k"))).alias("prior"))  # size: one row
    each = cells.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << d) - 1))))
    blank = each.select("mask", *(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.col(c)).alias(c) for i, c in enumerate(names)), "y", "n", "m")
    counted = blank.groupBy("mask", *names, "y").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    alike = counted.withColumn("total", F.sum("n").over(Window.partitionBy("mask", *names)))
    chance = (F.col("n") + alpha * F.col("prior")) / (F.col("total") + alpha)
    return alike.where("m > 0").join(prior, "y").groupBy(F.col("mask").cast("long").alias("mask")).agg((F.sum(F.col("m") * F.log(chance)) / F.sum("m")).alias("value"))


def _central(df: DataFrame, names: list[str]) -> dict[bool, tuple[int, np.ndarray]]:
    """{held: (rows, sums of products)} of columns centred on their training means, with a constant as the last column; two passes."""
    means = df.agg(*(F.avg(F.when(~F.col("h"), F.col(c))).alias(c) for c in names)).first()
    moved = [F.col(c) - F.lit(means[c] or 0.0) for c in names] + [F.lit(1.0)]
    places = [(i, j) for i in range(len(moved)) for j in range(i, len(moved))]
    out = {part: (0, np.zeros((len(moved), len(moved)))) for part in (False, True)}
    for r in df.groupBy("h").agg(F.count("*").alias("n"), *(F.sum(moved[i] * moved[j]).alias(f"s{i}_{j}") for i, j in places)).collect():
        g = np.zeros((len(moved), len(moved)))
        for i, j in places:
            g[i, j] = g[j, i] = r[f"s{i}_{j}"]
        out[r["h"]] = r["n"], g
    return out


def _score(mask: int, d: int, train: tuple[int, np.ndarray], test: tuple[int, np.ndarray], ridge: float) -> float:
    """Mean held-out log density of the target (column 0) given the coalition's columns, by least squares with normal residuals."""
    on = [1 + i for i in range(d) if mask >> i & 1] + [d + 1]
    (n, a), (m, b) = train, test
    scale = np.sqrt(np.where(np.diag(a)[on] > 0, np.diag(a)[on], 1.0))
    gram = a[np.ix_(on, on)] / np.outer(scale, scale) + ridge * np.eye(len(on))
    w = np.linalg.lstsq(gram, a[on, 0] / scale, rcond=1e-12)[0] / scale
    lost = lambda g: max(0.0, g[0, 0] - 2 * w @ g[on, 0] + w @ g[np.ix_(on, on)] @ w)
    variance = max(lost(a) / n, 1e-12)
    return float(-0.5 * (np.log(2 * np.pi * variance) + lost(b) / m / variance))


def linear_values(df: DataFrame, target: str, columns: list[str], held: Column, ridge: float = 0.0) -> DataFrame:
    """(mask, value) for linear predictors with normal residuals, whose variance is that of the training residuals (1e-12 at least).

    Rows with a null or non-finite number or an undefined `held` take no part; `ridge` is on the scale of columns of unit length. Without
    training or held-out rows there are no values. The Gram matrices (columns squared) are broadcast; tasks solve a share of the coalitions each.
    """
    d = _bounded(columns)
    names = ["y", *(f"c{i}" for i in range(d))]
    rows = df.select(*(F.col(c).cast("double").alias(k) for k, c in zip(names, [target, *columns])), held.alias("h"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in names]
    for f in finite:
        rows = rows.where(f)
    sums = _central(rows.where(F.col("h").isNotNull()), names)
    spark, masks = df.sparkSession, 1 << d if sums[False][0] and sums[True][0] else 0
    shared = spark.sparkContext.broadcast(sums)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train, test = shared.value[False], shared.value[True]
        for f in frames:
            yield pd.DataFrame({"mask": f["id"], "value": [_score(int(k), d, train, test, ridge) for k in f["id"]]})

    return spark.range(0, masks, 1, max(1, masks // 1024)).mapInPandas(run, "mask long, value double")


def information(values: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, marginal, conditional, shapley) of a value table: the gain over no column, over all others, and the mean over all orders."""
    whole = (1 << len(columns)) - 1
    names = values.sparkSession.createDataFrame([(1 << j, f) for j, f in enumerate(columns)], "bit long, feature string")
    value = lambda mask: F.max(F.when(F.col("mask") == mask, F.col("value")))
    ends = values.join(F.broadcast(names)).groupBy("feature").agg((value(F.col("bit")) - value(F.lit(0))).alias("marginal"), (value(F.lit(whole)) - value(F.lit(whole) - F.col("bit"))).alias("conditional"))
    return ends.join(shapley(values, columns), "feature")

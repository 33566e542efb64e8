"""Exact nearest neighbours of every point of its own system, leaving out points near in time, and what is predicted from them.

Points (system, t, state) are dealt to the cell of their nearest pivot; pivots are drawn by hash, one for about CELL points. A cell's
points travel in blocks of CELL or so, whatever their number, so repeated states meet no single task. Round one looks only into a
point's own block: its k-th distance there bounds the true one. Round two visits the blocks of every cell that the triangle inequality
doesn't rule out (distance to the pivot, less the cell's radius, is within the bound), in salted batches of queries; the k best of all
visits are the k nearest. Ties go to the earlier time. Distances are Euclidean, rounded to nine decimals.

Defined results: points whose system, t or state is null or holds null, nan or infinite numbers take no part; of a (system, t) that
repeats, each row is a library point, and all its rows share one answer set; a point with fewer than k others gets those it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled

#: Points of a block, and queries that visit a block in one batch.
CELL, BATCH = 2000, 4096
_SQUARES = "aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, z) -> s + z)"


def nearest(queries: np.ndarray, times: np.ndarray, library: np.ndarray, library_times: np.ndarray, k: int, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, library point, distance) of up to k nearest library points further than `radius` in time."""
    found = []
    for i in range(0, len(queries), rows):
        d = np.round(np.sqrt(((queries[i : i + rows, None] - library[None]) ** 2).sum(-1)), 9)
        d[np.abs(times[i : i + rows, None] - library_times[None]) <= radius] = np.inf
        order = np.lexsort((np.broadcast_to(library_times, d.shape), d), axis=1)[:, :k]
        near = np.take_along_axis(d, order, 1)
        row, place = np.nonzero(np.isfinite(near))
        found.append((row + i, order[row, place], near[row, place]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _valid(points: DataFrame) -> DataFrame:
    bad = F.exists("state", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = points.select(F.col("system").cast("string").alias("system"), F.col("t").cast("long").alias("t"), F.col("state").cast("array<double>").alias("state"))
    return rows.where(F.col("system").isNotNull() & F.col("t").isNotNull() & F.col("state").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def knn_join(points: DataFrame, k: int, radius: int = 0, cell: int = CELL) -> DataFrame:
    """(system, t, rank from 1, neighbour: its t, distance) for points (system, t, state)."""
    rows = _valid(points)
    sizes = rows.groupBy("system").agg(F.count("*").alias("_n"))
    drawn = rows.join(sizes, "system").where(F.pmod(F.xxhash64("t", "state"), F.greatest(F.least(F.col("_n"), F.lit(cell)), F.lit(1))) == 0).select("system", "state").distinct()
    some = rows.groupBy("system").agg(F.min_by("state", "t").alias("state"))  # so that every system has a pivot
    pivots = settled(drawn.union(some.select("system", "state")).distinct().groupBy("system").agg(F.array_sort(F.collect_list("state")).alias("pivots")))
    near = f"array_min(transform(pivots, (p, i) -> struct(sqrt({_SQUARES.format(a='p', b='state')}) AS d, i AS c)))"
    placed = settled(rows.join(pivots, "system").withColumn("_near", F.expr(near)).select("system", "t", "state", F.col("_near.c").alias("cell"), F.col("_near.d").alias("to_pivot")))
    cells = placed.groupBy("system", "cell").agg(F.max("to_pivot").alias("reach"), F.ceil(F.count("*") / cell).alias("blocks"))
    cells = settled(cells)
    block = F.pmod(F.xxhash64("t", "state"), F.col("blocks")).alias("block")
    library = settled(placed.join(cells.select("system", "cell", "blocks"), ["system", "cell"]).select("system", "t", "state", "cell", block))

    bound = "system string, t long, bound double"

    def own_block(frame: pd.DataFrame) -> pd.DataFrame:
        states, times = np.stack(frame["state"]), frame["t"].to_numpy()
        query, _, d = nearest(states, times, states, times, k, radius)
        counts = np.bincount(query, minlength=len(frame))
        worst = np.zeros(len(frame))
        np.maximum.at(worst, query, d)
        return pd.DataFrame({"system": frame["system"], "t": times, "bound": np.where(counts >= k, worst, np.inf)})

    bounds = library.groupBy("system", "cell", "block").applyInPandas(own_block, bound)
    bounds = settled(bounds.groupBy("system", "t").agg(F.min("bound").alias("bound")))
    reach = cells.groupBy("system").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("reach", "blocks")))).alias("reach"))
    queries = placed.groupBy("system", "t", "state").agg(F.count("*").alias("_copies")).drop("_copies").join(bounds, ["system", "t"]).join(pivots, "system").join(reach, "system")
    to = f"transform(pivots, (p, i) -> struct(sqrt({_SQUARES.format(a='p', b='state')}) AS d, i AS c))"
    # 1e-8: distances are rounded, and so is the sum of the inequality
    seen = queries.withColumn("_to", F.expr(f"filter({to}, x -> reach[x.c] IS NOT NULL AND x.d - reach[x.c].reach <= bound + 1e-8)"))
    visits = seen.select("system", "t", "state", F.explode("_to").alias("x"), "reach").select("system", "t", "state", F.col("x.c").alias("cell"), F.explode(F.expr("sequence(0L, reach[x.c].blocks - 1)")).alias("block"))
    visits = settled(visits)
    batches = visits.groupBy("system", "cell", "block").agg(F.ceil(F.count("*") / BATCH).alias("batches"))
    salted = visits.join(batches, ["system", "cell", "block"]).withColumn("batch", F.pmod(F.xxhash64("t", "state", F.lit(1)), F.col("batches"))).drop("batches")
    copies = library.join(batches, ["system", "cell", "block"]).withColumn("batch", F.explode(F.expr("sequence(0L, batches - 1)"))).drop("batches")

    def look(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"system": [], "t": [], "neighbour": [], "distance": []})
        query, point, d = nearest(np.stack(asked["state"]), asked["t"].to_numpy(), np.stack(held["state"]), held["t"].to_numpy(), k, radius)
        return pd.DataFrame({"system": asked["system"].to_numpy()[query], "t": asked["t"].to_numpy()[query], "neighbour": held["t"].to_numpy()[point], "distance": d})

    keys = ["system", "cell", "block", "batch"]
    found = salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(look, "system string, t long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("system", "t").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("system", "t", "rank", "neighbour", "distance")


def delays(series: DataFrame, dimension: int, delay: int = 1, value: str = "value") -> DataFrame:
    """(system, t, state): present value first, then `delay` steps apart; times without a full past are left out."""
    w = Window.partitionBy("system").orderBy("t")
    state = F.array(*(F.lag(value, j * delay).over(w) if j else F.col(value) for j in range(dimension)))
    return series.select("system", "t", state.alias("state"), F.row_number().over(w).alias("_r")).where(F.col("_r") > (dimension - 1) * delay).drop("_r")


def simplex_weight(distance: Column, first: Column) -> Column:
    """exp(-d / d1), 1e-6 at least; where the nearest distance is 0, 1 for zero distances and 1e-6 for the others."""
    return F.when(first == 0, F.when(distance == 0, 1.0).otherwise(1e-6)).otherwise(F.greatest(F.exp(-distance / F.when(first == 0, 1.0).otherwise(first)), F.lit(1e-6)))


def simplex_forecast(neighbours: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(system, t, predicted) from neighbours' targets (system, t, target); points with fewer than k neighbours or a neighbour without target have none."""
    first = F.min("distance").over(Window.partitionBy("system", "t"))
    weighed = neighbours.withColumn("weight", simplex_weight(F.col("distance"), first))
    joined = weighed.join(targets.select("system", F.col("t").alias("neighbour"), "target"), ["system", "neighbour"])
    sums = joined.groupBy("system", "t").agg(F.count("target").alias("n"), (F.sum(F.col("weight") * F.col("target")) / F.sum("weight")).alias("predicted"))
    return sums.where(F.col("n") == k).select("system", "t", "predicted")


def cross_map_skill(pairs: DataFrame, dimension: int, delay: int = 1, radius: int = 0) -> DataFrame:
    """(system, cause, effect, n, rho): the skill with which the effect's delays give back the cause, both directions; pairs: (system, t, x, y).

    The whole library is used. rho is null where fewer than 3 points are predicted or one side doesn't vary.
    """
    both = None
    for cause, effect in (("x", "y"), ("y", "x")):
        tag = F.concat_ws("\u0001", "system", F.lit(cause))
        own = pairs.select(tag.alias("system"), "t", F.col(effect).cast("double").alias("value"), F.col(cause).cast("double").alias("target"))
        both = own if both is None else both.unionByName(own)
    both = settled(both)
    found = knn_join(delays(both, dimension, delay), dimension + 1, radius)
    seen = simplex_forecast(found, both, dimension + 1).join(both.select("system", "t", "target"), ["system", "t"])
    rho = F.try_divide(F.covar_pop("predicted", "target"), F.stddev_pop("predicted") * F.stddev_pop("target"))
    out = seen.groupBy("system").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, rho).alias("rho"))
    parts = F.split("system", "\u0001")
    return out.select(parts[0].alias("system"), parts[1].alias("cause"), F.when(parts[1] == "x", "y").otherwise("x").alias("effect"), "n", "rho")

"""Operators over all pairs of entities, in blocks: each block pair is one bounded set of matrix products.

A table is cut into about SIDE blocks whatever its size, so each row is sent to about SIDE tasks and what is shuffled grows with the table, not
with its square; only tables beyond SIDE * LARGEST rows have more. Block pairs are visited in tiles, whose products are formed in single
precision; a pair whose place or rank that leaves open is worked out again in double precision, so results are those of double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least and the most rows of a block, and the blocks of a table between them.
BLOCK, LARGEST, SIDE = 1024, 1 << 16, 16
#: Rows and columns of a tile.
STRIP, TILE = 512, 2048
#: Pairs that are worked out in double precision at a time.
EXACT = 1 << 16
#: The most tasks that block pairs are dealt to; a task takes several beyond it.
MOST_TASKS = 20_000


def dealt(cells: DataFrame, count: int, *keys: str) -> DataFrame:
    """Cells parted by their keys into a task each. Cells are small to move and long to work on, so their bytes mustn't decide how many tasks there are."""
    return cells.repartition(max(1, min(4 * int(count), MOST_TASKS)), *keys)  # four times as many, so that few cells meet in a task


def block_count(rows: int, block: int = BLOCK) -> int:
    """The number of blocks of a table: `block` rows at least and LARGEST at most in each, between them SIDE blocks."""
    return rows // max(block, min(rows // SIDE, LARGEST)) + 1


def single_error(width: int) -> float:
    """A bound on the error of a single-precision product of vectors of at most unit length."""
    return (width + 16) * 1.2e-7


def in_parts(f: Callable[..., np.ndarray], *places: np.ndarray) -> np.ndarray:
    """f over places, EXACT of them at a time."""
    return np.concatenate([f(*(p[i : i + EXACT] for p in places)) for i in range(0, max(1, len(places[0])), EXACT)])


def nearest(rows: int, columns: int, rough: Callable[[slice, slice], np.ndarray], exact: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of each row's k least exact distances, ties to smaller columns.

    `rough` gives a tile of distances within `slack` of the exact ones, infinite for pairs that don't count; `exact` those of some pairs, nan for
    those that don't count. Only pairs that come near a row's k best so far are worked out.
    """
    found = []
    for i in range(0, rows, STRIP):
        own = slice(i, min(i + STRIP, rows))
        limit = np.full(own.stop - i, np.inf)
        row, column, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, columns, TILE):
            near = rough(own, slice(j, min(j + TILE, columns)))
            if not j and near.shape[1] > k:
                limit = np.partition(near, k - 1, axis=1)[:, k - 1].astype(float) + 2 * slack
            at = np.flatnonzero(near <= (limit[:, None] + slack).astype(near.dtype))
            at = at[np.isfinite(near.ravel()[at])]
            if not len(at):
                continue
            r, c = np.divmod(at, near.shape[1])
            d = in_parts(exact, i + r, j + c)
            good = d == d
            row, column, far = np.concatenate([row, r[good]]), np.concatenate([column, j + c[good]]), np.concatenate([far, d[good]])
            order = np.lexsort((column, far, row))
            row, column, far = row[order], column[order], far[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, column, far, place = (x[place < k] for x in (row, column, far, place))
            last = place == k - 1
            limit[row[last]] = np.minimum(limit[row[last]], far[last] + slack)
        found.append((i + row, column, far))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def block_pairs(df: DataFrame, key: str, vector: str, label: str, block: int = BLOCK, element: str = "double", placed: tuple[Column, int] | None = None) -> DataFrame:
    """(i_blk, j_blk, side, key, vector, label): every row dealt to the block pairs it takes part in, i_blk <= j_blk.

    All pairs are asked for, so the work is quadratic by nature; each task holds two blocks, whatever the table's size. `placed` gives each row's
    block and the number of blocks; without it blocks are cut by hash.
    """
    if placed:
        own, blocks = placed
    else:
        blocks = block_count(df.count(), block)
        own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast(f"array<{element}>").alias("vector"), F.col(label).cast("long").alias("label"), own.alias("blk"))
    left = rows.select(F.col("blk").alias("i_blk"), F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("j_blk"), F.lit(0).alias("side"), "key", "vector", "label")
    right = rows.where("blk > 0").select(F.explode(F.sequence(F.lit(0), F.col("blk") - 1)).alias("i_blk"), F.col("blk").alias("j_blk"), F.lit(1).alias("side"), "key", "vector", "label")
    return dealt(left.unionByName(right), blocks * (blocks + 1) // 2, "i_blk", "j_blk")


def _sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(left rows, right rows) by key; one frame where a block meets itself."""
    left = frame[frame["side"] == 0].sort_values("key")
    same = frame["i_blk"].iloc[0] == frame["j_blk"].iloc[0]
    return left, left if same else frame[frame["side"] == 1].sort_values("key")


def tiles(rows: int, columns: int, same: bool, strip: int = STRIP, tile: int = TILE):
    """(rows, columns, which pairs count once or None for all) of the tiles of a block pair; those below the diagonal are left out if it is one block."""
    for i in range(0, rows, strip):
        own = slice(i, min(i + strip, rows))
        for j in range(i // tile * tile if same else 0, columns, tile):
            other = slice(j, min(j + tile, columns))
            crossed = same and other.start < own.stop
            yield own, other, np.arange(i, own.stop)[:, None] < np.arange(j, other.stop)[None] if crossed else None


def _unit(frame: pd.DataFrame) -> np.ndarray:
    """Rows of length 1; nan where a vector is 0."""
    x = np.stack(frame["vector"]).astype(float)
    with np.errstate(invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squared(a: np.ndarray, b: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """r2 of pairs by places."""
    return lambda i, j: np.round((a[i] * b[j]).sum(1) ** 2, 9)


def pair_histogram(df: DataFrame, key: str, vector: str, label: str, bins: int = 20) -> DataFrame:
    """(r_bin, pairs, hits): the pairs by similarity r2 in right-closed bins, and those of equal label."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(frame)
        if not len(left) or not len(right):
            return pd.DataFrame({"r_bin": [], "pairs": [], "hits": []})
        a = _unit(left)
        b = a if left is right else _unit(right)
        exact, slack = _squared(a, b), np.float32(bins * (2 * single_error(a.shape[1]) + 1e-8))
        one, two = (np.nan_to_num(x).astype(np.float32) for x in (a, b))
        void = np.isnan(a).any() or np.isnan(b).any()
        first, second = left["label"].to_numpy(), right["label"].to_numpy()
        total, hits = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for own, other, once in tiles(len(a), len(b), left is right):
            r2 = one[own] @ two[other].T
            r2 *= r2
            r2 *= np.float32(bins)
            r2 -= slack
            place = r2.astype(np.int16)
            r2 += 2 * slack
            open_ = place != r2.astype(np.int16)
            open_ |= r2 >= bins
            if void:
                open_ |= np.isnan(a[own, :1]) | np.isnan(b[other, 0])
            if once is not None:
                open_ &= once
                place[~once] = -1
            at = np.flatnonzero(open_)
            if len(at):
                i, j = np.divmod(at, place.shape[1])
                r = in_parts(exact, own.start + i, other.start + j)
                place.ravel()[at] = np.clip(np.ceil(np.round(np.nan_to_num(r) * bins, 9)) - 1, 0, bins - 1)
            equal = first[own, None] == second[None, other]
            for k in range(bins):
                inside = place == k
                n = np.count_nonzero(inside)
                if n:
                    total[k] += n
                    hits[k] += np.count_nonzero(inside & equal)
        return pd.DataFrame({"r_bin": np.arange(bins), "pairs": total, "hits": hits})

    made = block_pairs(df, key, vector, label).groupBy("i_blk", "j_blk").applyInPandas(count, "r_bin int, pairs long, hits long")
    return made.groupBy("r_bin").agg(F.sum("pairs").alias("pairs"), F.sum("hits").alias("hits")).where("pairs > 0")


def calibration_curve(histogram: DataFrame) -> DataFrame:
    """(r_bin, pairs, p_equiv): the share of equal labels in each bin of similarity."""
    return histogram.select("r_bin", "pairs", F.try_divide("hits", "pairs").alias("p_equiv"))


def top_partners(df: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """(key, partner, r2, rank, same): the k most similar partners of each entity; blocks keep their own k best."""

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(frame)
        out = [pd.DataFrame({"key": [], "partner": [], "r2": [], "same": []})]
        if len(left) and len(right):
            a = _unit(left)
            b = a if left is right else _unit(right)
            for own, other, x, y in ((left, right, a, b),) if left is right else ((left, right, a, b), (right, left, b, a)):
                one, two = (np.nan_to_num(v).astype(np.float32) for v in (x, y))
                keys, others, squared = own["key"].to_numpy(), other["key"].to_numpy(), _squared(x, y)

                def rough(i: slice, j: slice, one=one, two=two, keys=keys, others=others) -> np.ndarray:
                    r = one[i] @ two[j].T
                    r *= -r
                    if left is right:
                        r[keys[i, None] == others[None, j]] = np.inf
                    return r

                row, column, far = nearest(len(x), len(y), rough, lambda i, j, f=squared: -f(i, j), k, 2 * single_error(x.shape[1]) + 1e-8)
                out.append(pd.DataFrame({"key": keys[row], "partner": others[column], "r2": -far, "same": own["label"].to_numpy()[row] == other["label"].to_numpy()[column]}))
        return pd.concat(out[-2:] if len(out) > 2 else out[-1:])

    made = block_pairs(df, key, vector, label).groupBy("i_blk", "j_blk").applyInPandas(best, "key long, partner long, r2 double, same boolean")
    return made.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("r2"), "partner"))).where(F.col("rank") <= k)


def equivalent_partner(partners: DataFrame) -> DataFrame:
    """(key, best_r2, has_equivalent) from each entity's partners."""
    return partners.groupBy("key").agg(F.max("r2").alias("best_r2"), F.bool_or("same").alias("has_equivalent"))

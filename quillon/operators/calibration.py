"""Calibration of one pair statistic by another over all pairs, with bootstrap intervals from one pass over the pairs.

An entity has two vectors. A pair falls into a bin of r2, the squared correlation of the first ones, and a bin of e, the correlation
or the proximity of the second ones. Replicate b counts a pair w_i * w_j times, where w is the entity's multiplicity in b: a Poisson
draw from a hash of entity and replicate, so that nothing about replicates is stored or shuffled but one small array an entity, and
any engine with MD5 draws the same. All replicates are counted in the same visit of a block pair: the pairs' products of multiplicities, several packed
into one whole number, are summed by cell for each tile. Replicate 0 is the data itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import BLOCK, _sides, block_pairs, in_parts, single_error, tiles

#: The distribution function of a Poisson number of mean 1 at 0..7; a draw beyond the last counts 8. Fixed values.
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.9999897508)
E_LIMIT = 1.024
#: Rows and columns of a tile: its arrays stay in a core's cache, and three replicates' sums over it fit into a whole number.
ROWS, COLUMNS = 256, 384


def multiplicity(key: Column, replicate: Column | int) -> Column:
    """How often a replicate has the entity: Poisson of mean 1 by MD5 of "replicate:key"; 1 in replicate 0."""
    replicate = replicate if isinstance(replicate, Column) else F.lit(replicate)
    text = F.concat_ws(":", replicate.cast("string"), key.cast("string")).cast("binary")
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = F.lit(0)
    for p in POISSON:
        drawn = drawn + (u > p).cast("int")
    return F.when(replicate == 0, F.lit(1)).otherwise(drawn).cast("double")


def _centred(x: np.ndarray) -> np.ndarray:
    """Rows less their mean, of length 1; 0 where one is constant."""
    x = x - x.mean(1, keepdims=True)
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _proximity(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2<a,b> / (<a,a> + <b,b>) of raw rows, from their products and squares: equal vectors have 1, and a shared mean counts."""
    return 2 * dot / (a + b + 1e-12)


def places(x: np.ndarray, low: float, width: float, bins: int) -> np.ndarray:
    """The right-closed bin of each number, clamped to the edges."""
    return np.clip(np.ceil(np.round((x - low) / width, 9)) - 1, 0, bins - 1).astype(np.int64)


def joint_histogram(df: DataFrame, key: str, first: str, second: str, replicates: int = 0, r_bins: int = 20, e_bins: int = 64, statistic: str = "correlation", block: int = BLOCK) -> DataFrame:
    """(replicate, r_bin, e_bin, pairs): weighted numbers of unordered pairs, replicates 0 (unweighted) to `replicates`.

    Rows whose key or a vector is null or whose vectors hold nulls take no part; all first vectors must be of one length, and all second ones.
    """
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    rows = df.where(F.col(key).isNotNull() & whole(first) & whole(second))
    sizes = rows.agg(F.max(F.size(first)), F.max(F.size(second))).first()
    one, two = int(sizes[0] or 0), int(sizes[1] or 0)
    weights = F.array(*(multiplicity(F.col(key), b) for b in range(replicates + 1)))
    packed = rows.select(key, F.concat(F.col(first).cast("array<double>"), F.col(second).cast("array<double>"), weights).alias("_packed"), F.lit(0).alias("_label"))
    near = statistic == "proximity"
    schema = "replicate int, r_bin int, e_bin int, pairs double"

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(frame)
        if not len(left) or not len(right):
            return pd.DataFrame({"replicate": [], "r_bin": [], "e_bin": [], "pairs": []})
        a, b = np.stack(left["vector"]), np.stack(right["vector"])
        a1, b1, own, weights = _centred(a[:, :one]), _centred(b[:, :one]), a[:, one + two :], b[:, one + two :]
        a2, b2 = a[:, one : one + two], b[:, one : one + two]
        a2, b2 = (a2, b2) if near else (_centred(a2), _centred(b2))
        p, q = (a2**2).sum(1), (b2**2).sum(1)

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            r2 = np.round(np.minimum((a1[i] * b1[j]).sum(1) ** 2, 0.999999), 9)
            dot = (a2[i] * b2[j]).sum(1)
            e = np.round(np.clip(_proximity(dot, p[i], q[j]) if near else dot, -E_LIMIT, E_LIMIT), 9)
            return places(r2, 0.0, 1 / r_bins, r_bins) * e_bins + places(e, -E_LIMIT, 2 * E_LIMIT / e_bins, e_bins)

        # Proximities come from vectors of length 1 and the ratio of the lengths, as squares may leave the range of single precision.
        n1, n2 = np.sqrt(p), np.sqrt(q)
        unit = lambda x, n: np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0)
        r_scale, e_scale = np.sqrt(r_bins), e_bins / (2 * E_LIMIT)
        s1, t1, s2, t2 = ((a1 * r_scale).astype(np.float32), b1.astype(np.float32), (unit(a2, n1) * e_scale).astype(np.float32), unit(b2, n2).astype(np.float32))
        r_slack, e_slack = np.float32(r_bins * (2 * single_error(one) + 1e-8)), np.float32(e_scale * (single_error(two) + 1e-6) + 1e-5)
        middle = np.float32(e_bins / 2 - e_slack)
        total = np.zeros((r_bins * e_bins, replicates + 1))
        for rows, columns, once in tiles(len(a), len(b), left is right, ROWS, COLUMNS):
            r2 = s1[rows] @ t1[columns].T
            r2 *= r2
            r2 -= r_slack
            e = s2[rows] @ t2[columns].T
            if near:
                e *= (_proximity(np.outer(n1[rows], n2[columns]), p[rows, None], q[None, columns])).astype(np.float32)
            e += middle
            # A number less its slack lies in the pair's bin, unless it comes within twice the slack of the next one.
            cell, place = np.trunc(r2), np.trunc(e)
            r2 -= cell
            edge = r2 >= 1 - 2 * r_slack
            edge |= e < 0
            e -= place
            edge |= e >= 1 - 2 * e_slack
            cell *= np.float32(e_bins)
            cell += place
            if once is not None:
                edge &= once
            cell = cell.astype(np.intp).ravel()
            at = np.flatnonzero(edge)
            if len(at):
                i, j = np.divmod(at, edge.shape[1])
                cell[at] = in_parts(exact, rows.start + i, columns.start + j)
            if once is not None:
                np.clip(cell, 0, r_bins * e_bins - 1, out=cell)  # pairs that don't count
            # Whole numbers below 2**53 are exact: so many replicates' products of multiplicities fit into one, whatever their sums are.
            bits = int((own[rows].sum(0) * weights[columns].sum(0)).max(initial=0)).bit_length() or 1
            for g in range(0, replicates + 1, max(1, 53 // bits)):
                of = np.arange(g, min(g + max(1, 53 // bits), replicates + 1))
                both = (own[rows][:, of] * 2.0 ** (bits * (of - g))) @ weights[columns][:, of].T
                if once is not None:
                    both *= once
                sums = np.bincount(cell, weights=both.ravel(), minlength=r_bins * e_bins).astype(np.int64)
                for r in of:
                    total[:, r] += sums >> bits * int(r - g) & (1 << bits) - 1
        cell, replicate = np.nonzero(total)
        return pd.DataFrame({"replicate": replicate, "r_bin": cell // e_bins, "e_bin": cell % e_bins, "pairs": total[cell, replicate]})

    made = block_pairs(packed, key, "_packed", "_label", block).groupBy("i_blk", "j_blk").applyInPandas(count, schema)
    return made.groupBy("replicate", "r_bin", "e_bin").agg(F.sum("pairs").alias("pairs"))


def center(e_bin: Column, e_bins: int = 64) -> Column:
    """The middle of a bin of e."""
    width = 2 * E_LIMIT / e_bins
    return F.lit(-E_LIMIT + width / 2) + e_bin * width


def curves(histogram: DataFrame, tau: float, e_bins: int = 64) -> DataFrame:
    """(replicate, r_bin, pairs, p_equiv, mean_e): the share of pairs in bins of e whose middle is over tau, and the mean middle."""
    e = center(F.col("e_bin"), e_bins)
    hits = F.sum(F.when(e > tau, F.col("pairs")).otherwise(0.0))
    return histogram.groupBy("replicate", "r_bin").agg(F.sum("pairs").alias("pairs"), F.try_divide(hits, F.sum("pairs")).alias("p_equiv"), F.try_divide(F.sum(e * F.col("pairs")), F.sum("pairs")).alias("mean_e"))


def intervals(curve: DataFrame, levels: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """(r_bin, p_equiv of the data, low, mid, high of the replicates); a bin that a replicate lacks has no value there."""
    drawn = F.percentile(F.when(F.col("replicate") > 0, F.col("p_equiv")), F.array(*(F.lit(x) for x in levels)))
    out = curve.groupBy("r_bin").agg(F.max(F.when(F.col("replicate") == 0, F.col("p_equiv"))).alias("p_equiv"), drawn.alias("q"))
    return out.select("r_bin", "p_equiv", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


def headline(curve: DataFrame, lowest: int, highest: int, levels: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """(quantity, observed, low, mid, high) of base rate, ceiling (bins lowest..highest, pooled) and lift, each formed within a replicate first."""
    inside = F.col("r_bin").between(lowest, highest)
    hits = F.col("pairs") * F.col("p_equiv")
    each = curve.groupBy("replicate").agg(F.try_divide(F.sum(hits), F.sum("pairs")).alias("base"), F.try_divide(F.sum(F.when(inside, hits)), F.sum(F.when(inside, F.col("pairs")))).alias("ceiling"))
    long = each.withColumn("lift", F.try_divide("ceiling", "base")).selectExpr("replicate", "stack(3, 'base', base, 'ceiling', ceiling, 'lift', lift) AS (quantity, value)")
    drawn = F.percentile(F.when(F.col("replicate") > 0, F.col("value")), F.array(*(F.lit(x) for x in levels)))
    out = long.groupBy("quantity").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("observed"), drawn.alias("q"))
    return out.select("quantity", "observed", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))

"""The driven-variable scan: which channels are better predicted once the rest of the system is known.

Input is long (t, channel, value). Per channel a polynomial ridge on its own delays is the baseline; the excess is what a shared
low-dimensional code of all channels adds on held-out time. Time-shifted copies of well-predicted channels set the threshold.

The codes are those of an ensemble of masked autoencoders (autoencoder.py). Training times come first, then a gap, then test times.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, finite_or
from ..storage import settled
from . import autoencoder


@dataclass(frozen=True)
class ScanConfig:
    dimension: int = 3
    degree: int = 3
    train: float = 0.6
    gap: float = 0.2
    code: int = 8
    members: int = 2
    masked: float = 0.25
    steps: int = 60
    rate: float = 0.01
    binary: bool = False
    fill: str = "zero"
    ridge: float = 1.0
    ghosts: int = 50
    difference: bool = True
    seed: int = 0


def products(own: np.ndarray, degree: int) -> np.ndarray:
    """All products of up to `degree` columns."""
    columns = [own[:, list(c)].prod(axis=1) for d in range(1, degree + 1) for c in combinations_with_replacement(range(own.shape[1]), d)]
    return np.stack(columns, axis=1)


def ridge_r2(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, alpha: float = 1.0, intercept: bool = False, ddof: int = 1) -> float:
    """Held-out R2 of a closed-form ridge fit, 0 at least. Penalty on the raw Gram matrix; several targets are averaged."""
    y, y2 = y.reshape(len(y), -1), y2.reshape(len(y2), -1)
    shift, level = (x.mean(0), y.mean(0)) if intercept else (0.0, 0.0)
    x, x2 = x - shift, x2 - shift
    weights = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - level))
    error, spread = ((y2 - level - x2 @ weights) ** 2).mean(0), y2.var(0, ddof=ddof)
    return float(np.where(spread > 0, np.maximum(0, 1 - error / np.where(spread > 0, spread, 1)), 0).mean())


def states(series: DataFrame, config: ScanConfig) -> DataFrame:
    """(channel, t, train, own, target): differenced, finite, varying channels; delays standardised on training time and clipped."""
    w = Window.partitionBy("channel").orderBy("t")
    value = F.col("value") - F.lag("value").over(w) if config.difference else F.col("value")
    df = series.select("channel", "t", finite_or(value.cast("double"), 0.0).alias("v"), F.row_number().over(w).alias("_r")).where(f"_r > {int(config.difference)}")
    group = Window.partitionBy("channel")
    df = df.withColumn("_s", F.stddev_pop("v").over(group)).where("_s > 1e-12")
    df = df.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_p", F.row_number().over(w))
    train = F.col("_p") <= F.floor(F.col("_n") * config.train)
    mine = F.when(train, F.col("v"))
    spread = F.stddev_pop(mine).over(group)
    z = clip((F.col("v") - F.avg(mine).over(group)) / F.when(spread > 0, spread).otherwise(1.0), -20.0, 20.0)
    df = df.select("channel", "t", "_p", "_n", z.alias("z"))
    own = F.array(*(F.lag("z", k).over(w) if k else F.col("z") for k in range(config.dimension)))
    df = df.select("channel", "t", "_p", "_n", own.alias("own"), F.lead("z", 1).over(w).alias("target"))
    kept = df.where((F.col("_p") >= config.dimension) & F.col("target").isNotNull())
    # The last `dimension` training rows go: their targets reach over the seam.
    edge = F.floor(F.col("_n") * config.train)
    return kept.where((F.col("_p") > F.floor(F.col("_n") * (config.train + config.gap))) | (F.col("_p") <= edge - config.dimension)).select("channel", "t", (F.col("_p") <= edge).alias("train"), "own", "target")


def wide_states(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """(t, train, x: all channels' delays in the order of the names) of the times at which no channel lacks, and the names."""
    names = sorted(r[0] for r in rows.select("channel").distinct().collect())
    packed = F.transform(F.array_sort(F.collect_list(F.struct("channel", "own"))), lambda s: s["own"].cast("array<float>"))
    wide = rows.groupBy("t").agg(F.flatten(packed).alias("x"), F.count(F.lit(1)).alias("_n"), F.bool_and("train").alias("train"))
    return wide.where(F.col("_n") == len(names)).select("t", "train", "x"), names


def trained(rows: DataFrame, config: ScanConfig) -> tuple[DataFrame, list[str], list, autoencoder.Training]:
    """(wide states, channels, the ensemble's parameters, how it was trained) on training times."""
    wide, names = wide_states(rows)
    wide = settled(wide)
    how = autoencoder.Training(config.code, config.members, config.masked, config.steps, config.rate, config.binary, config.fill, config.seed)
    return wide, names, autoencoder.train(wide.where("train").select("t", "x"), len(names) * config.dimension, config.dimension, how), how


def codes(rows: DataFrame, config: ScanConfig) -> DataFrame:
    """(t, code, width): for each time the codes of an ensemble of masked autoencoders, one after another."""
    wide, _, model, how = trained(rows, config)
    return autoencoder.encoded(wide, model, config.dimension, how)


def membership(series: DataFrame, config: ScanConfig | None = None, draws: int = 10) -> DataFrame:
    """(channel, membership, spread): how well held-out values of a channel are recreated from all others."""
    config = config or ScanConfig()
    wide, names, model, how = trained(settled(states(series, config)), config)
    return autoencoder.memberships(wide.where("not train"), names, model, config.dimension, how, draws if config.fill == "uniform" else 1)


def excesses(rows: DataFrame, coded: DataFrame, config: ScanConfig, by: str = "channel") -> DataFrame:
    """(by, excess, self_r2) of each channel: what the codes add to its own polynomial, each term floored at 0 before subtraction."""

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        own, y, train = products(np.stack(frame["own"]), config.degree), frame["target"].to_numpy(), frame["train"].to_numpy()
        code, width = np.stack(frame["code"]), int(frame["width"].iloc[0])
        if train.sum() < 2 or (~train).sum() < 2:
            return pd.DataFrame({by: frame[by].iloc[:1], "excess": [np.nan], "self_r2": [np.nan]})
        alone = ridge_r2(own[train], y[train], own[~train], y[~train], config.ridge)
        gain = [ridge_r2(x[train], y[train], x[~train], y[~train], config.ridge) - alone for x in (np.hstack([own, code[:, i : i + width]]) for i in range(0, code.shape[1], width))]
        return pd.DataFrame({by: frame[by].iloc[:1], "excess": [float(np.mean(gain))], "self_r2": [alone]})

    return rows.join(coded, "t").groupBy(by).applyInPandas(score, f"{by} string, excess double, self_r2 double")


#: Channels up to which a readout sees the whole state: each row then carries every other channel.
MOST_CHANNELS = 64
#: The ridge of the readout from raw states. Fixed value.
RAW_RIDGE = 100.0


def readouts(rows: DataFrame, coded: DataFrame, config: ScanConfig) -> DataFrame:
    """(channel, base, affine, interaction, raw, oracle, readout_share, compression_share): held-out R2 of a channel's own products (base), and
    what is added to it by the code, by the code and its products with own delays, by the other channels' delays under a strong ridge and by
    all their products. The shares split the gap between affine and oracle into what the readout and what the code lose; null without a gap.

    For up to MOST_CHANNELS channels; times at which a channel lacks are left out.
    """
    channels = rows.select("channel").distinct().count()
    if channels > MOST_CHANNELS:
        raise ValueError(f"{channels} channels, readouts take up to {MOST_CHANNELS}")
    whole = rows.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("channel", "own"))).alias("all")).where(F.size("all") == channels)
    others = F.flatten(F.transform(F.filter("all", lambda s: s["channel"] != F.col("channel")), lambda s: s["own"]))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        lags, y, train = np.stack(frame["own"]), frame["target"].to_numpy(), frame["train"].to_numpy()
        own, code, width = products(lags, config.degree), np.stack(frame["code"]), int(frame["width"].iloc[0])
        rest = np.stack(frame["others"])
        r2 = lambda alpha, *x: ridge_r2(np.hstack(x)[train], y[train], np.hstack(x)[~train], y[~train], alpha)
        base = r2(config.ridge, own)
        members = [code[:, i : i + width] for i in range(0, code.shape[1], width)]
        crossed = lambda c: (lags[:, :, None] * c[:, None, :]).reshape(len(c), -1)
        full = [products(rest[:, i : i + lags.shape[1]], config.degree) for i in range(0, rest.shape[1], lags.shape[1])]
        gains = {
            "affine": np.mean([r2(config.ridge, own, c) for c in members]) - base,
            "interaction": np.mean([r2(config.ridge, own, c, crossed(c)) for c in members]) - base,
            "raw": r2(RAW_RIDGE, own, rest) - base,
            "oracle": r2(config.ridge, own, *full) - base,
        }
        return pd.DataFrame({"channel": frame["channel"].iloc[:1], "base": [base], **{k: [float(v)] for k, v in gains.items()}})

    joined = rows.join(coded, "t").join(whole, "t").withColumn("others", others).drop("all")
    out = joined.groupBy("channel").applyInPandas(score, "channel string, base double, affine double, interaction double, raw double, oracle double")
    gap = F.col("oracle") - F.col("affine")
    share = lambda a, b: F.when(gap > 0, (F.col(a) - F.col(b)) / gap)
    return out.select("*", share("interaction", "affine").alias("readout_share"), share("oracle", "interaction").alias("compression_share"))


#: The self-prediction that a ghost's donor needs, and the fewest donors with which the ghosts are a calibrated null.
DONOR_R2, LEAST_DONORS = 0.9, 8


def ghost_rows(rows: DataFrame, scores: DataFrame, config: ScanConfig) -> DataFrame:
    """Rows of time-shifted copies: donors with self_r2 over 0.9 (all channels if fewer than 8), shifts in the middle half."""
    good = scores.where(F.col("self_r2") > DONOR_R2).select("channel")
    donors = good if good.count() >= LEAST_DONORS else scores.select("channel")
    order = F.xxhash64(F.lit(config.seed), F.col("channel"))
    donors = donors.orderBy(order).limit(config.ghosts)
    n = F.count(F.lit(1)).over(Window.partitionBy("channel"))
    placed = rows.join(F.broadcast(donors), "channel", "left_semi").withColumn("_p", F.row_number().over(Window.partitionBy("channel").orderBy("t")) - 1).withColumn("_n", n)
    quarter = F.floor(F.col("_n") / 4)
    shift = quarter + F.pmod(F.xxhash64(F.lit(config.seed + 1), F.col("channel")), F.greatest(2 * quarter, F.lit(1)))
    times = placed.select("channel", F.col("_p").alias("_q"), "t", "train")
    moved = placed.select("channel", F.pmod(F.col("_p") + shift, F.col("_n")).cast("int").alias("_q"), "own", "target")
    return times.join(moved, ["channel", "_q"]).select(F.concat(F.lit("ghost:"), "channel").alias("channel"), "t", "train", "own", "target")


def scan(series: DataFrame, config: ScanConfig = ScanConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channel scores with `driven`, ghost scores, one row of gates)."""
    rows = settled(states(series, config))
    coded = settled(codes(rows, config))
    scores = settled(excesses(rows, coded, config))
    ghosts = settled(excesses(ghost_rows(rows, scores, config), coded, config))
    threshold = ghosts.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("excess"), F.lit(0.0))).alias("threshold"))
    result = scores.join(F.broadcast(threshold)).withColumn("driven", F.col("excess") > F.col("threshold"))
    length = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("rows"))
    above = F.col("self_r2") > DONOR_R2
    own = result.agg(F.avg(F.col("driven").cast("int")).alias("driven_share"), F.median("self_r2").alias("self_r2_median"), F.max("self_r2").alias("self_r2_max"), F.avg(above.cast("int")).alias("donor_share"), F.count_if(above).alias("donors"))
    null = ghosts.agg(F.median("excess").alias("ghost_median"), F.max("excess").alias("ghost_max"))
    # Without enough channels that predict themselves the ghosts are a scale of noise, not a calibrated null.
    verdicts = (F.col("rows") >= 2000).alias("long_enough"), (F.col("donors") >= LEAST_DONORS).alias("saturated"), (F.col("ghost_median") <= 0.005).alias("clean_ghosts")
    gates = length.join(null).join(own).select("rows", "ghost_median", "ghost_max", "driven_share", "self_r2_median", "self_r2_max", "donor_share", "donors", *verdicts)
    return result, ghosts, gates


def threshold_rules(ghosts: DataFrame) -> DataFrame:
    """(rule, threshold) by each rule over the ghosts' excess."""
    q = F.percentile("excess", F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    row = ghosts.agg(F.max("excess").alias("max"), q.alias("q"), (F.avg("excess") + 3 * F.stddev_pop("excess")).alias("mean_3sd"))
    return row.selectExpr("stack(5, 'max', max, 'q99', q[2], 'q95', q[1], 'q90', q[0], 'mean_3sd', mean_3sd) AS (rule, threshold)")


def outflows(rows: DataFrame, coded: DataFrame, config: ScanConfig) -> DataFrame:
    """(channel, outflow): what a channel's own products add, beyond the present code, to predicting the code one step on."""
    ahead = coded.select("t", F.lead("code", 1).over(Window.partitionBy(F.floor(F.col("t") / 100_000)).orderBy("t")).alias("next"))
    joined = rows.join(coded, "t").join(ahead, "t").where(F.col("next").isNotNull())

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        own, train = products(np.stack(frame["own"]), config.degree), frame["train"].to_numpy()
        now, after = np.stack(frame["code"]), np.stack(frame["next"])
        if train.sum() < 2 or (~train).sum() < 2:
            return pd.DataFrame({"channel": frame["channel"].iloc[:1], "outflow": [np.nan]})
        r2 = [ridge_r2(x[train], after[train], x[~train], after[~train], config.ridge) for x in (now, np.hstack([now, own]))]
        return pd.DataFrame({"channel": frame["channel"].iloc[:1], "outflow": [r2[1] - r2[0]]})

    return joined.groupBy("channel").applyInPandas(score, "channel string, outflow double")

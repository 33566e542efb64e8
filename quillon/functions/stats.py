"""Statistics as compositions of aggregates; small exact tests as vectorised functions of summary rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..storage import settled
from .ranks import first_by_hash, running_counts, with_groups


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation, null where either is constant."""
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    top = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    below = F.sqrt((F.sum(F.col(x) * F.col(x)) - sx * sx / n) * (F.sum(F.col(y) * F.col(y)) - sy * sy / n))
    return F.when(~constant, F.try_divide(top, below))


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, rho) of average ranks inside each group."""
    from .ranks import average_rank

    ranked = df.select(by, average_rank([by], x).alias("_x"), average_rank([by], y).alias("_y"))
    return ranked.groupBy(by).agg(correlation("_x", "_y").alias("rho"))


def auroc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(n_pos, n_neg, u, auroc) with tied scores counted half, from distributed running counts."""
    runs = running_counts(df.where(positive.isNotNull()), score, {"p": positive.cast("long"), "n": (~positive).cast("long")})
    out = runs.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)).alias("u"))
    return out.withColumn("auroc", F.try_divide("u", F.col("n_pos") * F.col("n_neg")))


def auroc_ordinal(df: DataFrame, score: str, positive: Column, tie: str) -> DataFrame:
    """AUROC with tied scores in order of `tie`: (rank sum of positives - n1(n1+1)/2) / (n1 n0)."""
    runs = running_counts(df.select(F.struct(score, tie).alias("_s"), positive.alias("_p")).select(F.col("_s")[score].alias("s"), F.col("_s")[tie].alias("t"), "_p"), "s", {"all": F.lit(1).cast("long")})
    placed = df.select(F.col(score).alias("s"), F.col(tie).alias("t"), positive.alias("_p")).join(runs, "s")
    rank = F.col("all_before") + F.row_number().over(Window.partitionBy("s").orderBy("t"))
    out = placed.select(rank.alias("r"), "_p").agg(F.sum(F.when(F.col("_p"), F.col("r"))).alias("rs"), F.count_if("_p").alias("n1"), F.count_if(~F.col("_p")).alias("n0"))
    return out.select(F.try_divide(F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auroc"))


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Sum over distinct scores, best first, of recall gained times precision."""
    runs = running_counts(df.where(positive.isNotNull()), score, {"p": positive.cast("long"), "n": F.lit(1).cast("long")}, descending=True)
    precision = (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n"))
    return runs.agg(F.try_divide(F.sum(F.col("p") * precision), F.sum("p")).alias("average_precision"))


def gini(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, gini) of non-negative values."""
    ranked = df.select(by, value, F.row_number().over(Window.partitionBy(by).orderBy(value)).alias("_i"))
    n = F.count(F.lit(1))
    return ranked.groupBy(by).agg(F.try_divide(F.sum((2 * F.col("_i")) * F.col(value)), n * F.sum(value)).alias("_g"), n.alias("_n")).select(by, (F.col("_g") - (F.col("_n") + 1) / F.col("_n")).alias("gini"))


def profile_shape(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, excess kurtosis with small-sample correction, share of the 4 largest, participation ratio)."""
    ranked = df.select(by, F.col(value).alias("v"), F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value))).alias("_i"))
    sums = ranked.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.kurtosis("v").alias("k"), F.try_divide(F.sum(F.when(F.col("_i") <= 4, F.col("v"))), F.sum("v")).alias("top4_share"), F.try_divide(F.sum("v") * F.sum("v"), F.sum(F.col("v") * F.col("v"))).alias("participation"))
    n = F.col("n")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)
    return sums.select(by, F.when(n > 3, corrected).alias("kurtosis"), "top4_share", "participation")


def binned_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Plug-in mutual information (nats) of two discrete columns."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    left, right = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    joined = cells.join(left, a).join(right, b).join(F.broadcast(total))
    return joined.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))


def wasserstein(df: DataFrame, value: str, side: Column) -> DataFrame:
    """One-dimensional distance between the values of both sides: the integral of the distribution functions' difference."""
    counts = running_counts(df, value, {"a": side.cast("long"), "b": (~side).cast("long")}, following="_next")
    totals = counts.agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    gap = F.abs((F.col("a") + F.col("a_before")) / F.col("_na") - (F.col("b") + F.col("b_before")) / F.col("_nb"))
    return counts.join(F.broadcast(totals)).agg(F.sum(gap * (F.col("_next") - F.col(value))).alias("distance"))


def bootstrap_interval(df: DataFrame, by: str, value: str, key: str, resamples: int = 2000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, n, mean, low, high): percentile interval of a group's mean under resampling with replacement.

    `key` is a number that tells a group's rows apart; rows stand in its order. Draw i of resample b takes the row at the place md5 of "b:group:i" modulo
    n. Each row makes its own place's draws and draws meet rows by (group, place), so a large group is spread over all tasks; only the resamples' means
    (`resamples` a group) come together. Rows with a null group, key or value are left out.
    """
    rows = settled(df.select(F.col(by).alias("_g"), F.col(key).alias("_k"), F.col(value).alias("_v")).dropna())
    places = running_counts(rows, "_k", {"_n": F.lit(1).cast("long")}, by=("_g",)).select("_g", "_k", F.col("_n_before").alias("_i"))
    placed = settled(with_groups(rows.join(places, ["_g", "_k"]), ["_g"], n=F.count(F.lit(1)), mean=F.avg("_v")))
    draws = placed.select("_g", "n", "mean", "_i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", "_b", "_g", "_i").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = draws.select("_g", "n", "mean", "_b", place.alias("_i")).join(placed.select("_g", "_i", "_v"), ["_g", "_i"])
    means = drawn.groupBy("_g", "n", "mean", "_b").agg(F.avg("_v").alias("_m"))
    out = means.groupBy("_g", "n", "mean").agg(F.percentile("_m", F.array(F.lit(low), F.lit(high))).alias("_q"))
    return out.select(F.col("_g").alias(by), "n", "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def permutation_p(observed: Column, at_least: Column, draws: Column) -> Column:
    """(1 + draws at least as large) / (draws + 1); 1 where the observed value is undefined. Undefined draws count against it."""
    return F.when(observed.isNull() | F.isnan(observed), 1.0).otherwise((1 + at_least) / (draws + 1))


def permutation_test(df: DataFrame, value: str, positive: Column, key: str, draws: int) -> DataFrame:
    """(p) of the difference of means, positives' less others', against `draws` relabellings.

    Draw b calls those rows positive that come first by md5 of "b:key", as many as there are positives. The cut is a hash (see first_by_hash), so the copies
    of the rows are neither sorted nor shuffled; each draw is one conditional aggregate. Rows whose label is null are left out.
    """
    x = df.where(positive.isNotNull()).select(F.col(value).alias("_s"), positive.alias("_p"), F.col(key).alias("_key"))
    gap = lambda side: F.avg(F.when(side, F.col("_s"))) - F.avg(F.when(~side, F.col("_s")))
    copies = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_b"))
    hashed = F.md5(F.concat_ws(":", "_b", "_key").cast("binary"))
    relabelled = first_by_hash(copies, ["_b"], hashed, "_key", F.col("k"), {"k": F.col("_p").cast("long")}, "_first")
    null = relabelled.groupBy("_b").agg(gap(F.col("_first")).alias("d"))
    counted = null.join(F.broadcast(x.agg(gap(F.col("_p")).alias("seen")))).agg(F.first("seen").alias("seen"), F.count_if(F.col("d") >= F.col("seen")).alias("k"), F.count(F.lit(1)).alias("n"))
    return counted.select(permutation_p(F.col("seen"), F.col("k"), F.col("n")).alias("p"))


def rule_of_three(n: Column) -> Column:
    return 3.0 / F.greatest(n, F.lit(1))


def _upper_tail(k: int, low: int, high: int, mean: float, spread: float, ratio: Callable[[np.ndarray], np.ndarray]) -> float:
    """P(X >= k) on low..high where ratio(i) is the log of P(i + 1) / P(i).

    Only values within 60 deviations and 2000 of the mean are visited: by Bernstein's bound all others together are under 1e-300.
    """
    if k <= low:
        return 1.0
    reach = 60 * spread + 2000
    a, b = max(low, math.floor(mean - reach)), min(high, math.ceil(mean + reach))
    logs = np.concatenate([[0.0], np.cumsum(ratio(np.arange(a, b, dtype=float)))])
    chances = np.exp(logs - logs.max())
    return float(chances[max(k - a, 0) :].sum() / chances.sum())


def hypergeometric_tail(k: int, n: int, m: int, d: int) -> float:
    spread = math.sqrt(d * m / n * (n - m) / n * (n - d) / max(n - 1, 1)) if n else 0.0
    return _upper_tail(k, max(0, d - n + m), min(m, d), d * m / n if n else 0.0, spread, lambda i: np.log((m - i) * (d - i)) - np.log((i + 1) * (n - m - d + i + 1)))


@F.pandas_udf(DoubleType())
def hypergeometric_sf(k: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= k) of marked items among those drawn; the work grows with the distribution's width, the root of the numbers."""
    return pd.Series([hypergeometric_tail(*map(int, x)) for x in zip(k, population, marked, drawn)], dtype="float64")


@F.pandas_udf(DoubleType())
def sign_test(wins: pd.Series, n: pd.Series) -> pd.Series:
    """One-sided binomial P(X >= wins) at one half."""
    return pd.Series([_upper_tail(int(w), 0, int(m), m / 2, math.sqrt(m) / 2, lambda i, m=m: np.log(m - i) - np.log(i + 1)) for w, m in zip(wins, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series([None if x != x else 1 - NormalDist().cdf(x) for x in z], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series([NormalDist().inv_cdf(min(max(x, 1e-12), 1 - 1e-12)) for x in p])


def stouffer(df: DataFrame, p: str, weight: str) -> DataFrame:
    """Combined z of one-sided p-values."""
    z = df.select((-normal_quantile(F.col(p))).alias("z"), F.col(weight).alias("w"))
    return z.agg(F.try_divide(F.sum(F.col("w") * F.col("z")), F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("z"))


def mann_whitney(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """(u, n_pos, n_neg, rank_biserial, z): normal approximation with tie correction and continuity."""
    runs = running_counts(df, value, {"p": positive.cast("long"), "n": (~positive).cast("long")})
    t = F.col("p") + F.col("n")
    sums = runs.agg(F.sum("p").cast("double").alias("n_pos"), F.sum("n").cast("double").alias("n_neg"), F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)).alias("u"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n, product = F.col("n_pos") + F.col("n_neg"), F.col("n_pos") * F.col("n_neg")
    spread = F.sqrt(product / 12 * (n + 1 - F.try_divide("ties", n * (n - 1))))
    gap = F.col("u") - product / 2
    return sums.select("u", "n_pos", "n_neg", (2 * F.try_divide("u", product) - 1).alias("rank_biserial"), F.try_divide(gap - 0.5 * F.signum(gap), spread).alias("z"))


#: Differences up to which the rank sum's distribution is enumerated: time grows with their cube, memory with their square.
EXACT_DIFFERENCES = 2000


def _enumerated(ranks: np.ndarray, w: int) -> float:
    """Two-sided p of a sum w of positive (doubled) ranks over all signs. Chances of the sums are halved at each rank; those under 1e-308 become 0."""
    ways, far = np.zeros(int(ranks.sum()) + 1), 0
    ways[0] = 1
    for r in np.sort(ranks):
        ways[r : far + r + 1] += ways[: far + 1].copy()
        far += r
        ways[: far + 1] /= 2
    return float(min(1.0, 2 * min(ways[: w + 1].sum(), ways[w:].sum())))


def signed_rank_p(differences: np.ndarray) -> float:
    """Two-sided signed-rank p of paired differences; see signed_rank."""
    d = np.array([x for x in differences if x], float)
    if not len(d):
        return 1.0
    _, place, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (2 * np.cumsum(count) - count + 1)[place]
    if len(ranks) > EXACT_DIFFERENCES:
        off = abs(ranks[d > 0].sum() - ranks.sum() / 2) - np.gcd.reduce(ranks) / 2
        return math.erfc(max(off, 0.0) / math.sqrt((ranks.astype(float) ** 2).sum() / 4) / math.sqrt(2))
    return _enumerated(ranks, ranks[d > 0].sum())


@F.pandas_udf(DoubleType())
def wilcoxon_exact(differences: pd.Series) -> pd.Series:
    """Two-sided signed-rank p-value of arrays of paired differences; all of them count."""
    return pd.Series([signed_rank_p(d) for d in differences])


@F.pandas_udf(DoubleType())
def _enumerated_p(runs: pd.Series) -> pd.Series:
    """p of arrays of (doubled rank, rows, rows above 0)."""

    def p(rows):
        r, n, up = (np.array([x[k] for x in rows], int) for k in ("r", "n", "up"))
        return _enumerated(np.repeat(r, n), int(r @ up))

    return pd.Series([None if rows is None else p(rows) for rows in runs], dtype="float64")


@F.pandas_udf(DoubleType())
def _both_tails(z: pd.Series) -> pd.Series:
    return pd.Series([None if x != x else math.erfc(x / math.sqrt(2)) for x in z], dtype="float64")


def signed_rank(df: DataFrame, by: str, value: str, exact: int = EXACT_DIFFERENCES) -> DataFrame:
    """(by, n, p): two-sided signed-rank test of each group's paired differences, zeros left out; p is 1 where none is left.

    Mid-ranks come from running counts, so no task ranks a whole group. Up to `exact` differences p is that of the rank sum's distribution over all
    signs; a larger group's sum is compared with the normal distribution of its mean and its variance under ties, half a step of the
    sums nearer. Nulls and NaN take no part, nor does a null group.
    """
    clean = df.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_d")).where(F.col("_g").isNotNull() & F.col("_d").isNotNull() & ~F.isnan("_d"))
    sums = {"_n": F.lit(1), "_up": (F.col("_d") > 0).cast("int")}
    runs = running_counts(clean.where("_d <> 0").withColumn("_a", F.abs("_d")), "_a", sums, by=("_g",))
    ranked = runs.select("_g", (2 * F.col("_n_before") + F.col("_n") + 1).alias("r"), F.col("_n").alias("n"), F.col("_up").alias("up"))
    size = ranked.groupBy("_g").agg(F.sum("n").alias("_size"))
    few = ranked.join(size, "_g").where(F.col("_size") <= exact)
    r, n = F.col("r").cast("double"), F.col("n")
    totals = ranked.groupBy("_g").agg(F.sum("n").alias("n"), F.sum(r * F.col("up")).alias("w"), F.sum(r * n).alias("all"), F.sum(r * r * n).alias("squares"), F.bit_or("r").alias("bits"), F.min("r").alias("low"), F.max("r").alias("high"))
    bits = F.col("bits")
    step = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(bits.bitwiseAND(-bits))  # ranks are multiples of it
    z = F.greatest(F.abs(F.col("w") - F.col("all") / 2) - step / 2, F.lit(0.0)) / F.sqrt(F.col("squares") / 4)
    counted = few.groupBy("_g").agg(F.collect_list(F.struct("r", "n", "up")).alias("_few"))  # at most `exact` runs
    joined = clean.select("_g").distinct().join(totals, "_g", "left").join(counted, "_g", "left")
    p = F.coalesce(_enumerated_p("_few"), F.when(F.col("n") > 0, _both_tails(z)), F.lit(1.0))
    return joined.select(F.col("_g").alias(by), F.coalesce("n", F.lit(0)).alias("n"), p.alias("p"))


def cohort_splits(members: list, size: int) -> list[tuple[int, list]]:
    """Every choice of `size` members with its number; the driver's work is the small cohort's C(n, k)."""
    return [(i, list(c)) for i, c in enumerate(combinations(members, size))]


def cohort_p(spark, sums: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """For each cell the exact p-value of the gap in means between the first `size` members and the others, against the largest gap over
    cells of every choice of `size` members; sums and counts are members by cells. Choices are bit masks, dealt over tasks.
    """
    members = len(sums)

    def gaps(chosen: np.ndarray) -> np.ndarray:
        s, n = chosen @ sums, chosen @ counts
        rest = counts.sum(0) - n
        good = (n > 0) & (rest > 0)
        return np.where(good, np.abs(s / np.where(good, n, 1) - (sums.sum(0) - s) / np.where(good, rest, 1)), np.nan)

    seen = gaps((np.arange(members) < size).astype(float)[None])[0]

    def run(frames):
        for f in frames:
            if len(f):
                gap = gaps((f["id"].to_numpy()[:, None] >> np.arange(members) & 1).astype(float))
                largest = np.where(np.isnan(gap), -np.inf, gap).max(axis=1)
                largest = largest[np.isfinite(largest)]
                yield pd.DataFrame({"cell": np.arange(len(seen)), "hits": (largest[:, None] >= seen[None] - 1e-12).sum(0), "n": len(largest)})

    masks = spark.range(1 << members).where(F.bit_count("id") == size)
    out = masks.mapInPandas(run, "cell int, hits long, n long").groupBy("cell").agg((F.sum("hits") / F.sum("n")).alias("p")).collect()
    p = np.full(len(seen), np.nan)
    for r in out:
        p[r["cell"]] = r["p"] if np.isfinite(seen[r["cell"]]) else np.nan
    return p


#: Rows of a kernel matrix held at a time; results don't depend on it.
KERNEL_ROWS = 512


def median_gap(v: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The median positive squared distance of all pairs of numbers, 1 if there is none; by bisection over sorted values, without the pairs.

    With whole-number `weights` a number stands for so many equal ones, which gives the same as repeating it.
    """
    v, weights = np.asarray(v, float), np.ones(len(v), np.int64) if weights is None else np.asarray(weights, np.int64)
    v, at = np.unique(v, return_inverse=True)
    equal = np.zeros(len(v), np.int64)
    np.add.at(equal, at, weights)
    upto = np.concatenate([[0], np.cumsum(equal)])
    n = int(upto[-1])

    def within(gap: float) -> int:
        return int(equal @ upto[np.searchsorted(v, v + gap, side="right")]) - n * (n + 1) // 2

    none = int((equal * (equal - 1) // 2).sum())
    positive = n * (n - 1) // 2 - none
    if positive < 1:
        return 1.0

    def ranked(place: int) -> float:
        low, high = 0.0, float(v[-1] - v[0])
        while True:
            mid = (low + high) / 2
            if mid in (low, high):
                return high**2
            low, high = (low, mid) if within(mid) >= place else (mid, high)

    return (ranked(none + (positive + 1) // 2) + ranked(none + positive // 2 + 1)) / 2


def _dependences(x: np.ndarray, y: np.ndarray, orders: list[np.ndarray]) -> np.ndarray:
    """HSIC of x with y in each of the orders, from row sums and products of the kernels in blocks of KERNEL_ROWS rows."""
    n, a, b = len(x), median_gap(x), median_gap(y)
    k, m, joint = np.empty(n), np.empty(n), np.zeros(len(orders))
    for i in range(0, n, KERNEL_ROWS):
        rows = slice(i, i + KERNEL_ROWS)
        kernel = np.exp(-((x[rows, None] - x[None]) ** 2) / a)
        k[rows], m[rows] = kernel.sum(1), np.exp(-((y[rows, None] - y[None]) ** 2) / b).sum(1)
        for d, order in enumerate(orders):
            dealt = y[order]
            joint[d] += np.vdot(kernel, np.exp(-((dealt[rows, None] - dealt[None]) ** 2) / b))
    cross = np.array([k @ m[order] for order in orders])
    return (joint - 2 * cross / n + k.sum() * m.sum() / n**2) / max(n - 1, 1) ** 2


def hsic(x: np.ndarray, y: np.ndarray) -> float:
    """Dependence of two samples of numbers: centred Gaussian kernels at the median positive squared distance, over (n-1)^2; memory grows with n."""
    return float(_dependences(np.asarray(x, float), np.asarray(y, float), [np.arange(len(x))])[0])


def hsic_p(x: np.ndarray, y: np.ndarray, draws: int, seed: int) -> float:
    """(1 + permutations at least as dependent) / (draws + 1)."""
    rng = np.random.default_rng(seed)
    seen, *null = _dependences(np.asarray(x, float), np.asarray(y, float), [np.arange(len(y)), *(rng.permutation(len(y)) for _ in range(draws))])
    return float((1 + (np.array(null) >= seen - 1e-15).sum()) / (draws + 1))


def linear_cka(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two representations of the same rows; invariant to rotation, scale and shift, nan for a constant one."""
    if len(a) != len(b):
        raise ValueError("both representations need the same rows")
    a, b = a - a.mean(0), b - b.mean(0)
    below = np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b)
    return float(np.linalg.norm(a.T @ b) ** 2 / below) if below > 0 else float("nan")


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two probability arrays."""
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    part = lambda a: F.aggregate(F.zip_with(a, mid, lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return 0.5 * part(p) + 0.5 * part(q)

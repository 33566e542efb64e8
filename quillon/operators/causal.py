"""Orientation of a pair by additive-noise models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.stats import hsic_p

#: Residual variance, as a share of the target's, under which a fit counts as exact. Fixed value.
EXACT_SHARE = 1e-3
#: The verdicts.
INDEPENDENT, BIJECTION, UNDECIDED, NEITHER = "independent", "deterministic bijection: unidentifiable", "undecided: both admissible", "no ANM in either direction"
FORWARD, BACKWARD, EXACT_FORWARD, EXACT_BACKWARD = "x->y", "y->x", "x->y (deterministic)", "y->x (deterministic)"


def _near(k: int):
    """Means over the k nearest of sorted points; 2k candidates around each place, so memory grows with the rows."""

    def fit(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = np.searchsorted(a, at)[:, None] + np.arange(-k, k)[None]
        inside = (place >= 0) & (place < len(a))
        place = np.clip(place, 0, len(a) - 1)
        far = np.where(inside, np.abs(a[place] - at[:, None]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(a))]
        return b[np.take_along_axis(place, order, 1)].mean(axis=1)

    return fit


def _poly(degree: int):
    return lambda a, b, at: np.polyval(np.polyfit(a, b, degree), at)


def smooth_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fitted values of the candidate (polynomials, nearest-neighbour means) with the least even/odd validation error, refitted on all."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    even, odd = slice(0, None, 2), slice(1, None, 2)

    def error(fit) -> float:
        return ((fit(xs[even], ys[even], xs[odd]) - ys[odd]) ** 2).mean() + ((fit(xs[odd], ys[odd], xs[even]) - ys[even]) ** 2).mean()

    out = np.empty(len(x))
    out[order] = min([_poly(1), _poly(2), _poly(3), _poly(5), _near(3), _near(5), _near(15)], key=error)(xs, ys, xs)
    return out


def orient(x: np.ndarray, y: np.ndarray, alpha: float = 0.05, draws: int = 200, seed: int = 0) -> tuple[str, float, float, float, float, float]:
    """(verdict, p of independence, p of independent residuals forward and backward, residual shares forward and backward).

    A constant side is independent of the other. An exact fit leaves no residual to test: exact both ways is a bijection.
    """
    if len(x) < 12 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return INDEPENDENT, 1.0, 1.0, 1.0, 1.0, 1.0
    x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    ahead, back = y - smooth_fit(x, y), x - smooth_fit(y, x)
    marginal, p, q = hsic_p(x, y, draws, seed), hsic_p(x, ahead, draws, seed), hsic_p(y, back, draws, seed)
    shares = float(ahead.var()), float(back.var())
    exact, fits = tuple(s < EXACT_SHARE for s in shares), (p > alpha, q > alpha)
    by_exact = {(True, True): BIJECTION, (True, False): EXACT_FORWARD, (False, True): EXACT_BACKWARD}
    by_noise = {(True, False): FORWARD, (False, True): BACKWARD, (True, True): UNDECIDED, (False, False): NEITHER}
    verdict = INDEPENDENT if marginal > alpha else by_exact.get(exact) or by_noise[fits]
    return verdict, marginal, p, q, *shares


def anm_orient(samples: DataFrame, alpha: float = 0.05, draws: int = 200) -> DataFrame:
    """(pair, verdict, p_marginal, p_forward, p_backward, share_forward, share_backward) of each pair's rows (pair, x, y).

    Every row counts; rows with a null, nan or infinite side are left out, and a pair of fewer than 12 rows is independent. A pair's two
    columns are held by one task, its kernels only in blocks; time grows with the square of a pair's rows, as the test asks.
    """
    columns = ["verdict", "p_marginal", "p_forward", "p_backward", "share_forward", "share_backward"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        both = frame[["x", "y"]].to_numpy(float)
        both = both[np.isfinite(both).all(axis=1)]
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        return pd.DataFrame([[frame["pair"].iloc[0], *orient(both[:, 0], both[:, 1], alpha, draws)]], columns=["pair", *columns])

    return samples.groupBy("pair").applyInPandas(run, "pair string, verdict string, " + ", ".join(f"{c} double" for c in columns[1:]))

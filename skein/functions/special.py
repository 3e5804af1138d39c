"""Special functions and smoothers in NumPy, and their Arrow-batched forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOMENTS = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("variance", T.DoubleType())])

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def erfc(x) -> np.ndarray:
    return np.asarray(_erfc(np.asarray(x, float)), float)


def gammaln(x) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def digamma(x) -> np.ndarray:
    """Derivative of gammaln for x > 0: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        shift -= np.where(low, 1 / np.where(low, x, 1), 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def truncated_normal(mu, tau) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of N(mu, 1/tau) limited to x >= 0. Beyond 30 standard deviations below zero it is taken as an exponential; a
    precision of zero, and whatever is not finite or negative, gives zero."""
    mu, tau = np.broadcast_arrays(np.asarray(mu, float), np.asarray(tau, float))
    with np.errstate(all="ignore"):
        sigma = 1 / np.sqrt(tau)
        x = -mu / sigma
        hazard = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi) / (0.5 * erfc(x / math.sqrt(2)))
        mean = mu + sigma * hazard
        variance = sigma**2 * (1 - hazard * (hazard - x))
        tail = mu < -30 * sigma
        mean = np.where(tail, 1 / (np.abs(mu) * tau), mean)
        variance = np.where(tail, (1 / (np.abs(mu) * tau)) ** 2, variance)
        good = (tau > 0) & np.isfinite(mean) & np.isfinite(variance)
    return np.where(good & (mean >= 0), mean, 0.0), np.where(good & (variance >= 0), variance, 0.0)


def truncated_normal_mode(mu) -> np.ndarray:
    return np.maximum(0.0, mu)


def draw_truncated_normal(mu, tau, rng: np.random.Generator) -> np.ndarray:
    """Draws of N(mu, 1/tau) limited to x >= 0: rejection from the normal where zero is not far out, else Robert's exponential
    proposal. A precision of zero gives 0."""
    mu, tau = np.broadcast_arrays(np.asarray(mu, float), np.asarray(tau, float))
    out = np.zeros(mu.shape)
    for i in np.ndindex(mu.shape):
        if tau[i] <= 0:
            continue
        sigma = 1 / math.sqrt(tau[i])
        low = -mu[i] / sigma
        rate = (low + math.sqrt(low * low + 4)) / 2
        while True:
            if low < 0.5:
                z = rng.standard_normal()
                if z >= low:
                    break
            else:
                z = low + rng.exponential(1 / rate)
                if rng.random() <= math.exp(-0.5 * (z - rate) ** 2):
                    break
        out[i] = mu[i] + sigma * z
    return out


def draw_normal_between(low, high, mu, sigma, rng: np.random.Generator, size: int) -> np.ndarray:
    """Draws of N(mu, sigma^2) limited to [low, high], either end may be infinite: from the normal where the interval holds much of
    it, evenly with a Gaussian test where it is short, else Robert's exponential proposal for the tail that it lies in."""
    a, b = (low - mu) / sigma, (high - mu) / sigma
    if not a < b:
        raise ValueError("an empty interval")
    if b < 0:  # the upper tail alone is handled
        return 2 * mu - draw_normal_between(2 * mu - high, 2 * mu - low, mu, sigma, rng, size)
    out, have = np.empty(size), 0
    near = a if a > 0 else 0.0
    while have < size:
        n = 2 * (size - have) + 16
        if a < 0.5 and b - a > 1:
            z = rng.standard_normal(n)
            z = z[(z >= a) & (z <= b)]
        elif b - a <= 1 or not a > 0:
            z = rng.uniform(a, b, n)
            z = z[rng.random(n) <= np.exp(0.5 * (near * near - z * z))]
        else:
            rate = (a + math.sqrt(a * a + 4)) / 2
            z = a + rng.exponential(1 / rate, n)
            z = z[(rng.random(n) <= np.exp(-0.5 * (z - rate) ** 2)) & (z <= b)]
        take = min(len(z), size - have)
        out[have : have + take] = z[:take]
        have += take
    return mu + sigma * out


def gamma_draw(seed: int):
    """A pandas UDF (alpha, beta, row) -> a draw of Gamma(alpha, rate beta), the same for the same seed and row."""

    @F.pandas_udf(T.DoubleType())
    def draw(alpha: pd.Series, beta: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(r)]).gamma(a, 1 / b) for a, b, r in zip(alpha, beta, row, strict=True)], dtype=float)

    return draw


@F.pandas_udf(MOMENTS)
def truncated_normal_moments(mu: pd.Series, tau: pd.Series) -> pd.DataFrame:
    mean, variance = truncated_normal(mu.to_numpy(), tau.to_numpy())
    return pd.DataFrame({"mean": mean, "variance": variance})


@F.pandas_udf(T.DoubleType())
def digamma_udf(x: pd.Series) -> pd.Series:
    return pd.Series(digamma(x.to_numpy()))


def softmax(log_p: np.ndarray) -> np.ndarray:
    p = np.exp(log_p - log_p.max())
    return p / p.sum()


def lowess(x, y, span: float = 2 / 3, rounds: int = 3) -> np.ndarray:
    """Local linear smoothing at each x: tricube weights over the nearest `span` of the points, repeated with bisquare weights of
    the residuals."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    r = min(n - 1, int(math.ceil(span * n)))
    gap = np.abs(x[:, None] - x[None, :])
    width = np.maximum(np.sort(gap, axis=1)[:, r], 1e-12)
    near = (1 - np.clip(gap / width[:, None], 0, 1) ** 3) ** 3
    robust, fit = np.ones(n), y.copy()
    for _ in range(rounds):
        w = near * robust[None, :]
        s0, s1, s2 = w.sum(1), w @ x, w @ (x * x)
        t0, t1 = w @ y, w @ (x * y)
        det = s0 * s2 - s1 * s1
        slope = np.where(np.abs(det) > 1e-12, (s0 * t1 - s1 * t0) / np.where(np.abs(det) > 1e-12, det, 1), 0)
        fit = (t0 - slope * s1) / np.maximum(s0, 1e-300) + slope * x
        left = np.abs(y - fit)
        scale = 6 * np.median(left)
        robust = (1 - np.clip(left / scale, 0, 1) ** 2) ** 2 if scale > 0 else np.ones(n)
    return fit


def isotonic(x, y, increasing: bool) -> np.ndarray:
    """Monotone least-squares fit at each x (pool adjacent violators); equal x share one value."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    values, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    level = np.bincount(at, weights=y) / weight * (1 if increasing else -1)
    blocks: list[list[float]] = []
    for v, w in zip(level, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    fit = np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else level
    return (fit * (1 if increasing else -1))[at]

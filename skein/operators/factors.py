"""Masked matrix factorisation: multiplicative KL updates, and variational Gaussian factors with automatic relevance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.special import digamma, erfc, gammaln, truncated_normal

EPS = np.finfo(float).eps


def masked_ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x == 0, EPS, x) / np.where(y == 0, EPS, y)


def kl(x, fit, mask) -> float:
    return float((mask * (x * np.log(masked_ratio(x, fit)) - x + fit)).sum())


def kl_nmf(x, mask, rank: int, rng: np.random.Generator, rounds: int = 1000, restarts: int = 1, least: float = 1e-3, w=None) -> tuple[np.ndarray, np.ndarray, float]:
    """w, h and the divergence of the best restart; with w given, h alone is fitted."""
    best = None
    for _ in range(restarts):
        ww = rng.uniform(0, x.max() or 1, (x.shape[0], rank)) if w is None else w
        h = rng.uniform(0, x.max() or 1, (rank, x.shape[1]))
        last = np.inf
        for _ in range(rounds):
            h = np.maximum(h * masked_ratio(ww.T @ (mask * masked_ratio(x, ww @ h)), ww.T @ mask), EPS)
            if w is None:
                ww = np.maximum(ww * masked_ratio((mask * masked_ratio(x, ww @ h)) @ h.T, mask @ h.T), EPS)
            now = kl(x, ww @ h, mask)
            if abs(last - now) < least:
                break
            last = now
        if best is None or now < best[2]:
            best = (ww, h, now)
    return best


class VariationalFactors:
    """x ~ N(u v', 1/tau) with nonnegative factors: exponential priors of rate lam, or with relevance a gamma prior on each component's
    rate; precision 'learned' (one for all cells) or 'poisson' (1 / (x + 1/2) for each)."""

    ALPHA_TAU = BETA_TAU = 0.1
    ALPHA, BETA, RATE = 1e-6, 1e-6, 1e-3

    def __init__(self, x, mask, rank: int, rng: np.random.Generator, relevance: bool = True, precision: str = "learned"):
        if (mask.sum(0) == 0).any() or (mask.sum(1) == 0).any():
            raise ValueError("a row or a column has no observed cell")
        self.x, self.mask, self.rank, self.relevance, self.precision = x, mask, rank, relevance, precision
        scale = math.sqrt(max(x[mask > 0].mean(), EPS) / rank)
        self.u, self.v = rng.exponential(scale, (x.shape[0], rank)), rng.exponential(scale, (x.shape[1], rank))
        self.u_var, self.v_var = np.ones_like(self.u) * 1e-2, np.ones_like(self.v) * 1e-2
        self.u_mu, self.v_mu, self.u_tau, self.v_tau = self.u.copy(), self.v.copy(), 1 / self.u_var, 1 / self.v_var
        self.shape, self.rate = np.full(rank, self.ALPHA), np.full(rank, self.BETA)
        self._relevance()
        self._precision()

    def _relevance(self) -> None:
        if self.relevance:
            self.shape = np.full(self.rank, self.ALPHA + sum(self.x.shape))
            self.rate = self.BETA + self.u.sum(0) + self.v.sum(0)
            self.lam = self.shape / self.rate
        else:
            self.lam = np.full(self.rank, self.RATE)

    def square_error(self) -> np.ndarray:
        own = (self.u**2) @ (self.v**2).T
        return (self.x - self.u @ self.v.T) ** 2 + (self.u_var + self.u**2) @ (self.v_var + self.v**2).T - own

    def _precision(self) -> None:
        if self.precision == "poisson":
            self.tau, self.log_tau = 1 / (self.x + 0.5), -np.log(self.x + 0.5)
            return
        self.a = self.ALPHA_TAU + self.mask.sum() / 2
        self.b = self.BETA_TAU + 0.5 * (self.mask * self.square_error()).sum()
        self.tau = np.full(self.x.shape, self.a / self.b)
        self.log_tau = np.full(self.x.shape, float(digamma(self.a) - math.log(self.b)))

    def _side(self, x, mask, tau, own, other, other_var, k: int):
        left = x - own @ other.T + np.outer(own[:, k], other[:, k])
        t = (mask * tau) @ (other_var[:, k] + other[:, k] ** 2)
        mu = (-self.lam[k] + (mask * tau * left) @ other[:, k]) / np.maximum(t, 1e-300)
        return mu, t, *truncated_normal(mu, t)

    def train(self, rounds: int) -> VariationalFactors:
        for _ in range(rounds):
            self._relevance()
            for k in range(self.rank):
                self.u_mu[:, k], self.u_tau[:, k], self.u[:, k], self.u_var[:, k] = self._side(self.x, self.mask, self.tau, self.u, self.v, self.v_var, k)
            for k in range(self.rank):
                self.v_mu[:, k], self.v_tau[:, k], self.v[:, k], self.v_var[:, k] = self._side(self.x.T, self.mask.T, self.tau.T, self.v, self.u, self.u_var, k)
            self._precision()
        return self

    def log_likelihood(self) -> float:
        n = self.mask.sum()
        return float(0.5 * ((self.mask * self.log_tau).sum() - n * math.log(2 * math.pi)) - 0.5 * (self.mask * self.tau * self.square_error()).sum())

    def bound(self) -> float:
        out = self.log_likelihood()
        log_lam = digamma(self.shape) - np.log(self.rate) if self.relevance else np.log(self.lam)
        out += sum(self.x.shape) * log_lam.sum() - (self.lam * (self.u.sum(0) + self.v.sum(0))).sum()
        for mu, tau, mean, var in ((self.u_mu, self.u_tau, self.u, self.u_var), (self.v_mu, self.v_tau, self.v, self.v_var)):
            inside = np.maximum(0.5 * erfc(-mu * np.sqrt(np.maximum(tau, 0)) / math.sqrt(2)), 1e-100)
            out += (-0.5 * np.log(np.maximum(tau, 1e-300) / (2 * math.pi)) + np.log(inside) + 0.5 * tau * (var + (mean - mu) ** 2)).sum()
        if self.relevance:
            a, b = self.shape, self.rate
            out += (self.ALPHA * math.log(self.BETA) - math.lgamma(self.ALPHA) + (self.ALPHA - 1) * log_lam - self.BETA * self.lam).sum()
            out += (-a * np.log(b) + gammaln(a) - (a - 1) * log_lam + b * self.lam).sum()
        if self.precision == "learned":
            log_tau = float(digamma(self.a) - math.log(self.b))
            out += self.ALPHA_TAU * math.log(self.BETA_TAU) - math.lgamma(self.ALPHA_TAU) + (self.ALPHA_TAU - 1) * log_tau - self.BETA_TAU * self.a / self.b
            out += -self.a * math.log(self.b) + math.lgamma(self.a) - (self.a - 1) * log_tau + self.a
        return float(out)

    def quality(self, metric: str) -> float:
        """loglikelihood, bic, aic, mse or elbo."""
        n, k = self.mask.sum(), self.rank * sum(self.x.shape)
        return {
            "loglikelihood": self.log_likelihood, "bic": lambda: -2 * self.log_likelihood() + k * math.log(n), "aic": lambda: -2 * self.log_likelihood() + 2 * k,
            "mse": lambda: float((self.mask * (self.x - self.u @ self.v.T) ** 2).sum() / n), "elbo": self.bound,
        }[metric]()


def to_matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, mask, row and column ids of cells (v, s, x, mask); absent cells are masked."""
    rows, i = np.unique(pdf["v"], return_inverse=True)
    columns, j = np.unique(pdf["s"], return_inverse=True)
    x, mask = np.zeros((len(rows), len(columns))), np.zeros((len(rows), len(columns)))
    x[i, j], mask[i, j] = pdf["x"], pdf["mask"]
    return x, mask, rows, columns


def variational_restarts(cells: DataFrame, rank: int, restarts: int, seed: int, rounds: int = 200) -> DataFrame:
    """(model, restart, mse, elbo, kept): one fit for each restart and model of cells (model, v, s, x, mask), each in a task of its own."""
    spark = cells.sparkSession
    grid = cells.crossJoin(F.broadcast(spark.range(restarts).withColumnRenamed("id", "restart")))  # a few copies of a small matrix

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, mask, _, _ = to_matrix(pdf)
        fit = VariationalFactors(x, mask, rank, np.random.default_rng([seed, int(pdf["restart"].iloc[0])])).train(rounds)
        kept = int(((fit.u.sum(0) > 1e-3) & (fit.v.sum(0) > 1e-3)).sum())
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "restart": [pdf["restart"].iloc[0]], "mse": [fit.quality("mse")], "elbo": [fit.bound()], "kept": [kept]})

    return grid.groupBy("model", "restart").applyInPandas(run, cells.select("model").schema.add("restart", "long").add("mse", "double").add("elbo", "double").add("kept", "integer"))

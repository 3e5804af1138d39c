"""Matrices in long form (v, s, value), masked errors, divergences and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import ratio


def product(left: DataFrame, right: DataFrame, row: str, inner: str, column: str) -> DataFrame:
    """(row, column, value): sum over inner of left (row, inner, a) times right (inner, column, b)."""
    return left.join(right, inner).groupBy(row, column).agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def product_without(left: DataFrame, right: DataFrame, row: str, inner: str, column: str, leave: Column) -> DataFrame:
    """The product and, as `without`, the product less the terms where `leave` holds."""
    term = F.col("a") * F.col("b")
    own = F.sum(F.when(leave, term).otherwise(F.lit(0.0)))
    return left.join(right, inner).groupBy(row, column).agg(F.sum(term).alias("value"), (F.sum(term) - own).alias("without"))


def group_errors(cells: DataFrame) -> DataFrame:
    """(gene, mean_diff, mse) of cells (gene, v, s, x, xn, len, pred): mean over segments of the mean squared (pred - xn), and mean squared
    (x - len * pred)."""
    per = cells.groupBy("gene", "v").agg(F.avg((F.col("pred") - F.col("xn")) ** 2).alias("d"), F.sum((F.col("x") - F.col("len") * F.col("pred")) ** 2).alias("e"), F.count("*").alias("n"))
    return per.groupBy("gene").agg(F.avg("d").alias("mean_diff"), (F.sum("e") / F.sum("n")).alias("mse"))


def masked_fit(cells: DataFrame) -> DataFrame:
    """(n, mse, r2, rp) of the cells (x, pred, mask) with a mask of 1: mean squared error, share of variance (infinite if there is none),
    and Pearson's correlation."""
    on = cells.where("mask = 1")
    sums = on.agg(
        F.count("*").alias("n"), F.avg((F.col("x") - F.col("pred")) ** 2).alias("mse"), F.var_pop("x").alias("v"), F.var_pop("pred").alias("w"), F.covar_pop("x", "pred").alias("c")
    )
    return sums.select("n", "mse", F.when(F.col("v") == 0, F.lit(float("inf"))).otherwise(1 - F.col("mse") / F.col("v")).alias("r2"), (F.col("c") / F.sqrt(F.col("v") * F.col("w"))).alias("rp"))


def kl_divergence(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys + kl: sum of x ln(x / pred) - x + pred, zeros replaced in the ratio."""
    return cells.groupBy(*keys).agg(F.sum(F.col("x") * F.ln(ratio(F.col("x"), F.col("pred"))) - F.col("x") + F.col("pred")).alias("kl"))


def poisson_score(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys + score: half of (sum w - n ln 2 pi) less half of sum w (x - pred)^2, w = 1 / (x + 1/2), over cells with a mask of 1."""
    w = 1 / (F.col("x") + 0.5)
    on = cells.where("mask = 1")
    return on.groupBy(*keys).agg((0.5 * (F.sum(w) - F.count("*") * math.log(2 * math.pi)) - 0.5 * F.sum(w * (F.col("x") - F.col("pred")) ** 2)).alias("score"))


def squared_moments(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (lam, lam2): sum of p g, and the expectation of its square, of terms with first and second moments (p, p2, g, g2)."""
    return terms.groupBy(*keys).agg(
        F.sum(F.col("p") * F.col("g")).alias("lam"),
        (F.sum(F.col("p") * F.col("g")) * F.sum(F.col("p") * F.col("g")) - F.sum(F.col("p") ** 2 * F.col("g") ** 2) + F.sum(F.col("p2") * F.col("g2"))).alias("lam2"),
    )


def expected_square_error(x: Column, length: Column, theta: Column, theta2: Column, lam: Column, own: Column, second: Column) -> Column:
    """(x - len theta lam)^2 + len^2 (theta2 second - theta^2 own); own = sum p^2 g^2, second = sum p2 g2."""
    return (x - length * theta * lam) ** 2 + length**2 * (theta2 * second - theta**2 * own)


def gamma_posterior(cells: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(shape, rate, mean) of one precision for all cells (err2) with a mask of 1: alpha + n/2 and beta + half the summed squared error."""
    on = cells.where("mask = 1").agg((F.lit(alpha) + F.count("*") / 2).alias("shape"), (F.lit(beta) + 0.5 * F.sum("err2")).alias("rate"))
    return on.withColumn("mean", F.col("shape") / F.col("rate"))


def relevance(loads: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(g, shape, rate, mean): automatic relevance of each component from its loads (g, value)."""
    return loads.groupBy("g").agg((F.lit(alpha) + F.count("*")).alias("shape"), (F.lit(beta) + F.sum("value")).alias("rate")).withColumn("mean", F.col("shape") / F.col("rate"))


def multiplicative_step(w: DataFrame, h: DataFrame, x: DataFrame) -> DataFrame:
    """(k, s, value): one masked KL update of h (k, s, b) given w (v, k, a) and cells x (v, s, x, mask)."""
    from skein.functions.columns import EPS

    on = x.where("mask = 1")
    fit = w.join(h, "k").groupBy("v", "s").agg(F.sum(F.col("a") * F.col("b")).alias("fit"))
    quotient = on.join(fit, ["v", "s"]).select("v", "s", ratio(F.col("x"), F.col("fit")).alias("q"))
    up = quotient.join(w, "v").groupBy("k", "s").agg(F.sum(F.col("a") * F.col("q")).alias("num"), F.sum("a").alias("den"))
    return h.join(up, ["k", "s"]).select("k", "s", F.greatest(F.col("b") * ratio(F.col("num"), F.col("den")), F.lit(EPS)).alias("value"))


def deviance(tau: Column, log_tau: Column, square_error: Column) -> Column:
    """Half of tau E - ln tau."""
    return 0.5 * tau * square_error - 0.5 * log_tau


def gene_deviance(cells: DataFrame) -> DataFrame:
    """(gene, mean_deviance): mean over segments of the mean over samples; cells: (gene, v, s, tau, log_tau, err2)."""
    per = cells.groupBy("gene", "v").agg(F.avg(deviance(F.col("tau"), F.col("log_tau"), F.col("err2"))).alias("d"))
    return per.groupBy("gene").agg(F.avg("d").alias("mean_deviance"))


def expected_log_likelihood(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys + score: half of (sum ln tau - n ln 2 pi) less half of sum tau err2 over cells with a mask of 1."""
    on = cells.where("mask = 1")
    return on.groupBy(*keys).agg((0.5 * (F.sum("log_tau") - F.count("*") * math.log(2 * math.pi)) - 0.5 * F.sum(F.col("tau") * F.col("err2"))).alias("score"))


def shift_component(fit: DataFrame, phi: DataFrame, gamma: DataFrame, component: int, sign: int) -> DataFrame:
    """(v, s, value) of fit plus (sign 1) or less (-1) phi (v, g, p) times gamma (g, s, y) of one component."""
    p, y = phi.where(F.col("g") == component).select("v", "p"), gamma.where(F.col("g") == component).select("s", "y")
    return fit.join(p, "v", "left").join(y, "s", "left").select("v", "s", (F.col("value") + F.lit(float(sign)) * F.coalesce(F.col("p") * F.col("y"), F.lit(0.0))).alias("value"))


def frobenius(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys + frobenius: half of the summed squared (x - pred), cells with a mask of 1."""
    return cells.where("mask = 1").groupBy(*keys).agg((0.5 * F.sum((F.col("x") - F.col("pred")) ** 2)).alias("frobenius"))


def binarised(loads: DataFrame) -> DataFrame:
    """(v, g, on): whether a load (v, g, value) is above half of its component's median."""
    median = loads.groupBy("g").agg(F.median("value").alias("m"))
    return loads.join(median, "g").select("v", "g", (F.col("value") > 0.5 * F.col("m")).alias("on"))


def collapsed(loads: DataFrame, least: float = 1e-3) -> DataFrame:
    """Loads of components whose sum is above least."""
    return loads.join(loads.groupBy("g").agg(F.sum("value").alias("t")).where(F.col("t") > least).select("g"), "g", "left_semi")


def flow_divergences(cells: DataFrame, keys: list[str], delta: float = 1e-9, precision: float = 1e-15) -> DataFrame:
    """keys + (kl, rms) of counts x against the rate (phi + delta) len, cells (x, phi, len, mask)."""
    rate = (F.col("phi") + delta) * F.col("len")
    return cells.groupBy(*keys).agg(
        F.sum(F.col("mask") * (rate - F.col("x") - F.col("x") * F.ln(rate) + F.col("x") * F.ln(F.col("x") + precision))).alias("kl"),
        F.sqrt(F.sum((F.col("mask") * (rate - F.col("x"))) ** 2) / F.sum("mask")).alias("rms"),
    )

"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Double-precision machine epsilon, which stands in for zeros in ratios.
EPS = 2.220446049250313e-16


def nonzero(x: Column) -> Column:
    return F.when(x == 0, F.lit(EPS)).otherwise(x)


def ratio(x: Column, y: Column) -> Column:
    """x / y with zeros on either side replaced by EPS."""
    return nonzero(x) / nonzero(y)


def softmax_over(log_p: Column, keys: list[str]) -> Column:
    """exp(log_p) over its sum within the keys, the largest taken off first."""
    w = Window.partitionBy(*keys)
    shifted = F.exp(log_p - F.max(log_p).over(w))
    return shifted / F.sum(shifted).over(w)


def entropy(p: Column) -> Column:
    """Natural entropy of an array of probabilities; zeros add nothing."""
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))


def symmetric_difference_size(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def mean_color(colors: Column) -> Column:
    """Mean of an array of RRGGBB colours, rounded down, upper case."""

    def channel(i: int) -> Column:
        part = F.transform(colors, lambda c: F.conv(F.substring(c, i, 2), 16, 10).cast("int"))
        mean = F.floor(F.aggregate(part, F.lit(0), lambda acc, x: acc + x) / F.size(colors))
        return F.lpad(F.hex(mean), 2, "0")

    return F.concat(channel(1), channel(3), channel(5))


def corrected_kmer_count(kc: Column, length: Column, k: int) -> Column:
    return kc * length / (length - k)


def tent(phi: Column) -> Column:
    """The distance from 0 or 1, whichever is nearer."""
    return F.when(phi < 0.5, phi).otherwise(1 - phi)


def gamma_mode(alpha: Column, beta: Column) -> Column:
    return (alpha - 1) / beta


def exponential_draw(rate: Column, seed: int) -> Column:
    """A draw for each row; the same seed and partitioning draw the same."""
    return -F.ln(1 - F.rand(seed)) / rate


def normal_draw(mu: Column, tau: Column, seed: int) -> Column:
    """N(mu, 1 / tau)."""
    return mu + F.randn(seed) / F.sqrt(tau)

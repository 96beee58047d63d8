"""Probability distributions: pdf, cdf and quantile as Column expressions; draws are quantiles of uniform numbers."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


class Distribution(ABC):
    """Over the integers min .. max - 1, unless a class says otherwise."""

    @abstractmethod
    def cdf(self, x: Column) -> Column: ...

    @abstractmethod
    def quantile(self, u: Column) -> Column: ...

    def pdf(self, x: Column) -> Column:
        return self.cdf(x) - self.cdf(x - 1)

    def expected_count(self, x: Column, total: float) -> Column:
        return self.pdf(x) * total

    def choose(self, seed: int) -> Column:
        return self.quantile(F.rand(seed))


@dataclass(frozen=True)
class Uniform(Distribution):
    min: int
    max: int

    def cdf(self, x):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - self.min + 1) / (self.max - self.min)))

    def quantile(self, u):
        return (F.floor(u * (self.max - self.min)) + self.min).cast("long")


@lru_cache
def harmonic(n: int, shape: float) -> float:
    """Sum of k ** -shape; beyond a million terms by Euler-Maclaurin."""
    exact = min(n, 1_000_000)
    total = math.fsum(k**-shape for k in range(1, exact + 1))
    if n > exact:
        integral = math.log(n / exact) if shape == 1 else (n ** (1 - shape) - exact ** (1 - shape)) / (1 - shape)
        total += integral + (n**-shape - exact**-shape) / 2
    return total


@dataclass(frozen=True)
class Zipf(Distribution):
    """Rank k of n has weight k ** -shape, 0 < shape < 1; the quantile is the usual closed-form approximation."""

    min: int
    max: int
    shape: float

    def pdf(self, x):
        k = x - self.min + 1
        inside = (k >= 1) & (k <= self.max - self.min)
        return F.when(inside, F.pow(k.cast("double"), F.lit(-self.shape)) / harmonic(self.max - self.min, self.shape)).otherwise(F.lit(0.0))

    def cdf(self, x):
        """Exact by a sum over the ranks up to x."""
        k = F.least(x - self.min + 1, F.lit(self.max - self.min)).cast("int")
        ranks = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
        total = F.aggregate(ranks, F.lit(0.0), lambda s, r: s + F.pow(r.cast("double"), F.lit(-self.shape)))
        return F.when(k < 1, F.lit(0.0)).otherwise(total / harmonic(self.max - self.min, self.shape))

    def quantile(self, u):
        n, zn, z2 = self.max - self.min, harmonic(self.max - self.min, self.shape), 1 + 0.5**self.shape
        alpha = 1 / (1 - self.shape)
        eta = (1 - (2 / n) ** (1 - self.shape)) / (1 - z2 / zn) if n > 2 else 1.0
        rank = F.when(u * zn < 1, F.lit(0)).when(u * zn < z2, F.lit(1)).otherwise(F.floor(n * F.pow(F.lit(eta) * u - eta + 1, F.lit(alpha))))
        return (F.least(rank, F.lit(n - 1)) + self.min).cast("long")


@dataclass(frozen=True)
class Geometric(Distribution):
    """min, min + 1, ... with success probability p, cut at max - 1."""

    min: int
    max: int
    p: float

    def cdf(self, x):
        k = x - self.min + 1
        return F.when(x >= self.max - 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.pow(F.lit(1 - self.p), k.cast("double"))))

    def quantile(self, u):
        k = F.ceil(F.log(1 - u) / math.log(1 - self.p))
        return F.least(F.greatest(k, F.lit(1)) - 1 + self.min, F.lit(self.max - 1)).cast("long")


@dataclass(frozen=True)
class LogNormal(Distribution):
    """exp of a normal variable around ln(median), rounded down and kept within min .. max - 1."""

    min: int
    max: int
    median: float
    sigma: float

    def cdf(self, x):
        z = (F.log(F.greatest(x + 1, F.lit(1)).cast("double")) - math.log(self.median)) / self.sigma
        return F.when(x < self.min, F.lit(0.0)).when(x >= self.max - 1, F.lit(1.0)).otherwise(normal_cdf(z))

    def quantile(self, u):
        return self._bounded(F.exp(normal_quantile(u) * self.sigma + math.log(self.median)))

    def choose(self, seed):
        return self._bounded(F.exp(F.randn(seed) * self.sigma + math.log(self.median)))

    def _bounded(self, x: Column) -> Column:
        return F.greatest(F.lit(self.min), F.least(F.lit(self.max - 1), F.floor(x))).cast("long")


def normal_cdf(z: Column) -> Column:
    """By the logistic approximation of Bowling and others; off by 0.00014 at most."""
    return 1 / (1 + F.exp(-(0.07056 * z * z * z + 1.5976 * z)))


def normal_quantile(u: Column) -> Column:
    """The inverse of ``normal_cdf`` by the real root of its cubic."""
    a, b = 0.07056, 1.5976
    y = F.log(u / (1 - u))
    p, q = b / a, -y / a
    root = F.sqrt(q * q / 4 + p**3 / 27)
    return F.cbrt(-q / 2 + root) + F.cbrt(-q / 2 - root)


@dataclass(frozen=True)
class Empirical(Distribution):
    """Piecewise linear between points (value, cumulative probability) that rise to 1."""

    points: tuple[tuple[float, float], ...]

    def cdf(self, x):
        out = F.when(x < self.points[0][0], F.lit(0.0))
        for (v0, p0), (v1, p1) in zip(self.points, self.points[1:], strict=False):
            out = out.when(x < v1, p0 + (x - v0) * ((p1 - p0) / (v1 - v0)))
        return out.otherwise(F.lit(1.0))

    def quantile(self, u):
        out = F.when(u <= self.points[0][1], F.lit(float(self.points[0][0])))
        for (v0, p0), (v1, p1) in zip(self.points, self.points[1:], strict=False):
            if p1 > p0:
                out = out.when(u <= p1, v0 + (u - p0) * ((v1 - v0) / (p1 - p0)))
        return out.otherwise(F.lit(float(self.points[-1][0])))


@dataclass(frozen=True)
class Exponential(Distribution):
    """Over the non-negative reals, by its mean."""

    mean: float

    def cdf(self, x):
        return F.when(x < 0, F.lit(0.0)).otherwise(1 - F.exp(-x / self.mean))

    def quantile(self, u):
        return -F.log(1 - u) * self.mean


@dataclass(frozen=True)
class PowerLaw(Distribution):
    """Pareto over start .. infinity with density exponent ``exponent`` above 1; ``shift`` is added to draws."""

    exponent: float
    start: float = 1.0
    shift: float = 0.0

    def cdf(self, x):
        y = x - self.shift
        return F.when(y < self.start, F.lit(0.0)).otherwise(1 - F.pow(y / self.start, F.lit(1 - self.exponent)))

    def quantile(self, u):
        return self.start * F.pow(1 - u, F.lit(1 / (1 - self.exponent))) + self.shift


#: Link counts by id1, and access to ids, by mode: ``n`` is the number of ids, ``k`` the mode's parameter.
LINK_COUNTS: dict[str, Callable[[Column, int, int], Column]] = {
    "const": lambda i, n, k: F.lit(k).cast("long"),
    "reciprocal": lambda i, n, k: F.ceil(F.lit(n) / i).cast("long"),
    "multiples": lambda i, n, k: F.when(i % k == 0, F.lit(k)).otherwise(F.lit(0)).cast("long"),
    "exponential": lambda i, n, k: F.when(F.log2(i) == F.floor(F.log2(i)), i).otherwise(F.lit(0)).cast("long"),
    "perfect_squares": lambda i, n, k: F.when(F.floor(F.sqrt(i)) * F.floor(F.sqrt(i)) == i, F.floor(F.sqrt(i))).otherwise(F.lit(0)).cast("long"),
}
ACCESS: dict[str, Callable[[Column, Column, int, int], Column]] = {
    "round_robin": lambda r, u, n, k: F.pmod(r, F.lit(n)).cast("long"),
    "reciprocal": lambda r, u, n, k: F.ceil(F.lit(n) / F.ceil(u * n)).cast("long") - 1,
    "multiple": lambda r, u, n, k: (F.floor(u * F.ceil(F.lit(n) / k)) * k).cast("long"),
    "power": lambda r, u, n, k: F.floor(F.pow(u, F.lit(k)) * n).cast("long"),
    "perfect_power": lambda r, u, n, k: F.pow(F.floor(F.pow(u * n, F.lit(1 / k))), F.lit(k)).cast("long"),
}

REGISTRY: dict[str, type[Distribution]] = {c.__name__: c for c in (Uniform, Zipf, Geometric, LogNormal, Empirical, Exponential, PowerLaw)}


def register(name: str, kind: type[Distribution]) -> None:
    """Make a distribution of one's own available by name."""
    REGISTRY[name] = kind

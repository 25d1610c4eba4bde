"""Scalar pieces of the anomaly score, as Columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score.
EPS = 1e-6  # keeps the logarithms of the tail fit finite
MIN_LOG_STD = 1.5  # below this spread a fitted normal says nothing
ROOT = 15.0
UNKNOWN = 0.5  # rarity taken for an author without a profile
MIN_SAMPLES = 5
MIN_PAIR_SAMPLES = 10
ESTABLISHED = 20  # commits that an author must exceed
THRESHOLD = 0.962
WINDOW = 200
KAPPA = 4.0
SEVERITY = {"critical": 0.95, "high": 0.9, "medium": 0.6, "low": 0.3}
OTHER_SEVERITY = 0.5


def num(x: float) -> Column:
    return F.lit(float(x))


def contribution(rarity: Column) -> Column:
    """Share of the final score that a rarity gives: 1 - (1 - x)^(1/15); negative for a negative rarity, never clamped."""
    return num(1) - F.pow(num(1) - rarity, num(1 / ROOT))


def prob_or(values: Sequence[Column]) -> Column:
    """1 - product(1 - v): the same for any order, exact where one value is 1."""
    out = num(1)
    for v in values:
        out = out * (num(1) - v)
    return num(1) - out


def tail_rarity(value: Column, alpha: Column, beta: Column) -> Column:
    """Fitted probability of a smaller value, 1 - (alpha / v)^beta, at least 0; 0 for value 0 or null."""
    v = value.cast("double")
    return F.when(v.isNull() | (v == 0), num(0)).otherwise(F.greatest(num(0), num(1) - F.pow(alpha / F.when(v != 0, v), beta)))


def circular_density(histogram: Column, period: int) -> Column:
    """Array of von Mises kernel sums at 0 .. period-1 over a histogram (array of ``period`` counts)."""
    kernel = F.array(*[num(math.exp(KAPPA * math.cos(2 * math.pi * d / period))) for d in range(period)])
    places = F.sequence(F.lit(0), F.lit(period - 1))
    at = lambda q: F.aggregate(places, num(0), lambda acc, h: acc + F.get(histogram, h) * F.get(kernel, F.pmod(h - q, F.lit(period))))
    return F.transform(places, at)


def circular_rarity(value: Column, density: Column) -> Column:
    """1 - density(value) / highest density; 1 where all densities are 0."""
    top = F.array_max(density)
    return num(1) - F.when(top > 0, F.get(density, value) / top).otherwise(num(0))


def _erfc_terms(n: int = 28) -> list[float]:
    """Chebyshev coefficients of g in erfc(z) = t exp(-z^2 + g(t)), t = 2 / (2 + z), over z >= 0."""
    from numpy.polynomial import chebyshev

    def g(x: np.ndarray) -> np.ndarray:
        out = []
        for v in x:
            t = (v + 1) / 2
            z = 2 / t - 2
            if z < 25:
                log_erfc = math.log(math.erfc(z))
            else:  # asymptotic series where erfc itself underflows
                log_erfc = -z * z - math.log(z * math.sqrt(math.pi)) + math.log1p(-1 / (2 * z * z) + 3 / (4 * z**4) - 15 / (8 * z**6))
            out.append(log_erfc + z * z - math.log(t))
        return np.array(out)

    return chebyshev.chebinterpolate(g, n - 1).tolist()


ERFC_TERMS = _erfc_terms()


def erf_abs(z: Column) -> Column:
    """erf(|z|), with the error of erfc relative (about 1e-14), as the score takes roots of it."""
    a = F.abs(z)
    t = num(2) / (num(2) + a)
    x = num(2) * t - num(1)
    terms = F.array(*[num(c) for c in reversed(ERFC_TERMS[1:])])
    step = lambda acc, c: F.struct((num(2) * x * acc["b"] - acc["c"] + c).alias("b"), acc["b"].alias("c"))
    clenshaw = F.aggregate(terms, F.struct(num(0).alias("b"), num(0).alias("c")), step)
    g = x * clenshaw["b"] - clenshaw["c"] + num(ERFC_TERMS[0])
    return num(1) - t * F.exp(-a * a + g)


def z_score(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, F.abs(value - mean) / F.when(sd > 0, sd))


def normal_rarity(value: Column, n: Column, mean: Column, sd: Column) -> Column:
    """Two-sided probability of a value nearer to the mean; 0.5 for a null value, under 5 samples or too small a spread."""
    usable = value.isNotNull() & (n >= MIN_SAMPLES) & (sd >= MIN_LOG_STD)
    return F.when(usable, erf_abs(z_score(value, mean, sd) / num(math.sqrt(2)))).otherwise(num(UNKNOWN))


def signing_score(signed: Column, n_signed: Column, total: Column) -> Column:
    """0.85 for an unsigned commit (null counts as unsigned) of an author who signs more than half."""
    usual = (total >= MIN_SAMPLES) & (n_signed > total * num(0.5))
    return F.when(usual & ~F.coalesce(signed, F.lit(False)), num(0.85)).otherwise(num(0))


def identity_score(mismatch: Column, n_mismatch: Column, total: Column) -> Column:
    """Up to 0.35 where author and committer differ though they do in less than a fifth of the author's commits."""
    rate = n_mismatch / F.when(total > 0, total)
    rare = F.coalesce(mismatch, F.lit(False)) & (total >= MIN_SAMPLES) & (rate < 0.2)
    return F.when(rare, num(0.35) * (num(1) - rate / num(0.2))).otherwise(num(0))


def severity_score(severity: Column) -> Column:
    out = None
    for name, score in SEVERITY.items():
        out = F.when(severity == name, num(score)) if out is None else out.when(severity == name, num(score))
    return out.otherwise(num(OTHER_SEVERITY))

"""Special functions as Column expressions: no Python on the executors.

Sums and steps of fixed length are folds over literal arrays, so an argument is written once in a
plan however often it is used.  Tails are logarithms.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import _LOG_SCALED, LN10

#: ln of what is left of exp(x^2) erfc(x) after t = 2 / (2 + x) is taken out, by powers of 2 t - 1, highest first.
ERFC_POWERS = np.polynomial.chebyshev.cheb2poly(_LOG_SCALED[:32])[::-1].tolist()
SHIFT = 10
#: Coefficients of the asymptotic series in 1 / x^2, after the leading terms (Bernoulli numbers; fixed values).
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
#: Nodes and weights of the integral from 0 to infinity by v = exp(pi / 2 sinh k).
_K = np.arange(-40, 46) / 12.0
NODES = np.exp(np.pi / 2 * np.sinh(_K)).tolist()
WEIGHTS = (np.exp(np.pi / 2 * np.sinh(_K)) * np.pi / 2 * np.cosh(_K) / 12.0).tolist()
NORMAL_STEPS, INVERSE_STEPS = 14, 40
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _with(x: Column, f) -> Column:
    """``f`` of x, which is evaluated once."""
    return F.transform(F.array(x), f)[0]


def polynomial(x: Column, powers) -> Column:
    """Horner's rule, highest power first."""
    start = F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("s"))
    return F.aggregate(_array(powers), start, lambda a, c: F.struct(a["x"].alias("x"), (a["s"] * a["x"] + c).alias("s")), lambda a: a["s"])


def log_erfc(x: Column) -> Column:
    """ln erfc(x) for x >= 0, far into the tail."""
    return _with(x.cast("double"), lambda z: polynomial(4.0 / (2.0 + z) - 1.0, ERFC_POWERS) + F.ln(2.0 / (2.0 + z)) - z * z)


def chi2_log_tail(stat: Column, df: Column) -> Column:
    """ln P(chi2 > stat) for one or two degrees of freedom; null for others."""
    return F.when(df == 2, -stat / 2).when(df == 1, F.least(F.lit(0.0), log_erfc(F.sqrt(stat / 2))))


def neglog10(log_p: Column) -> Column:
    return -log_p / LN10


def _series(y: Column, coefficients) -> Column:
    """Sum of c_k / y^(2 k), k from 0."""
    return polynomial(1.0 / (y * y), coefficients[::-1])


def log_gamma(x: Column) -> Column:
    def at(z: Column) -> Column:
        y = z + SHIFT
        passed = F.aggregate(_array(range(SHIFT)), F.lit(1.0), lambda a, k: a * (z + k))
        return (y - 0.5) * F.ln(y) - y + HALF_LOG_2PI + _series(y, LGAMMA_SERIES) / y - F.ln(passed)

    return _with(x.cast("double"), at)


def digamma(x: Column) -> Column:
    def at(z: Column) -> Column:
        y = z + SHIFT
        return F.ln(y) - 0.5 / y + _series(y, DIGAMMA_SERIES) / (y * y) - F.aggregate(_array(range(SHIFT)), F.lit(0.0), lambda a, k: a + 1.0 / (z + k))

    return _with(x.cast("double"), at)


def trigamma(x: Column) -> Column:
    def at(z: Column) -> Column:
        y = z + SHIFT
        return 1.0 / y + 0.5 / (y * y) + _series(y, TRIGAMMA_SERIES) / (y * y * y) + F.aggregate(_array(range(SHIFT)), F.lit(0.0), lambda a, k: a + 1.0 / ((z + k) * (z + k)))

    return _with(x.cast("double"), at)


def trigamma_inverse(y: Column) -> Column:
    """x with trigamma(x) = y > 0, between bounds that hold it: 1 / x < trigamma(x) < 1 / x + 1 / x^2, halved in logarithms."""
    def at(v: Column) -> Column:
        start = F.struct((-F.ln(v)).alias("a"), F.ln((1.0 + F.sqrt(1.0 + 4.0 * v)) / (2.0 * v)).alias("b"))

        def halve(s: Column, _: Column) -> Column:
            return _with((s["a"] + s["b"]) / 2, lambda m: _with(trigamma(F.exp(m)) > v, lambda low: F.struct(F.when(low, m).otherwise(s["a"]).alias("a"), F.when(low, s["b"]).otherwise(m).alias("b"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(INVERSE_STEPS)), start, halve, lambda s: F.exp((s["a"] + s["b"]) / 2))

    return _with(y.cast("double"), at)


def t_log_two_sided(t: Column, df: Column) -> Column:
    """ln P(|T| > |t|): the density at |t|, times an integral over what comes after it in units of its fall there."""
    def at(s: Column) -> Column:
        z, n = s["t"], s["n"]
        unit = 1.0 / ((n + 1.0) * z / (n + z * z) + F.sqrt((n + 1.0) / n))
        density = log_gamma((n + 1.0) / 2) - log_gamma(n / 2) - 0.5 * F.ln(n) - 0.5 * math.log(math.pi) - (n + 1.0) / 2 * F.log1p(z * z / n)
        fall = lambda v: F.exp(-(n + 1.0) / 2 * (F.log1p((z + unit * v) * (z + unit * v) / n) - F.log1p(z * z / n)))
        rest = F.aggregate(F.arrays_zip(_array(NODES).alias("v"), _array(WEIGHTS).alias("w")), F.lit(0.0), lambda a, q: a + q["w"] * fall(q["v"]))
        return F.least(F.lit(0.0), math.log(2.0) + density + F.ln(unit * rest))

    return _with(F.struct(F.abs(t).cast("double").alias("t"), df.cast("double").alias("n")), at)


def chi2_of_log_tail(log_p: Column) -> Column:
    """x with ln P(chi2_1 > x) = log_p, by Newton steps on the root of x."""
    def at(lp: Column) -> Column:
        far = F.sqrt(F.greatest(-2.0 * lp - F.ln(F.greatest(-2.0 * lp, F.lit(1.0))) - F.when(lp < -3.0, math.log(math.pi / 2)).otherwise(0.0), F.lit(1e-6)))

        def step(z: Column, _: Column) -> Column:
            def move(tail: Column) -> Column:
                slope = -F.exp(0.5 * math.log(2 / math.pi) - z * z / 2 - tail)
                return F.greatest(z - (tail - lp) / slope, z / 8)

            return _with(log_erfc(z / math.sqrt(2.0)), move)

        return F.when(lp < 0, _with(F.aggregate(F.sequence(F.lit(1), F.lit(NORMAL_STEPS)), far, step), lambda z: z * z)).otherwise(0.0)

    return _with(log_p.cast("double"), at)

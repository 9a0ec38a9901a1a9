"""Detection by logistic regression that has a maximum however cells are separated.

Coefficients have independent Cauchy priors, of scale 10 for the intercept and 2.5 for the difference of the arms
(fixed values of the published method).  The mode is found by expectation-maximisation: a Cauchy is a normal with an unknown
variance, each step takes one weighted least-squares step under the present variances, then the variances' expectations.
Two groups need no cells: the fit is a fold of Column expressions over the 2 x 2 counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native

SCALES, STEPS = (10.0, 2.5), 120


def _rate(eta: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-eta))


def _expected(b: Column, v: Column, scale: float) -> Column:
    """Prior variance of a coefficient, given its value and its own variance."""
    return (b * b + v + scale * scale) / 2


def _fold(start: dict[str, Column], step) -> Column:
    struct = lambda d: F.struct(*[c.cast("double").alias(k) for k, c in d.items()])
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), struct(start), lambda s, _: step(s, struct))


def fitted(k: tuple[Column, Column], n: tuple[Column, Column]) -> tuple[Column, Column]:
    """(full: b0, b1, v0, v1, se; null: b0, v0) of detections k among n cells an arm."""
    k, n = ([c.cast("double") for c in x] for x in (k, n))

    def step(s: Column, struct) -> Column:
        sums = {"p0": _rate(s["b0"]), "p1": _rate(s["b0"] + s["b1"])}

        def weighed(q: Column) -> Column:
            w = [n[j] * q[f"p{j}"] * (1 - q[f"p{j}"]) for j in (0, 1)]
            g1 = w[1] * (s["b0"] + s["b1"]) + k[1] - n[1] * q["p1"]
            return struct({"w0": w[0], "w1": w[1], "g0": w[0] * s["b0"] + k[0] - n[0] * q["p0"] + g1, "g1": g1})

        def solved(a: Column) -> Column:
            a00, a11 = a["w0"] + a["w1"] + 1 / s["v0"], a["w1"] + 1 / s["v1"]
            det = a00 * a11 - a["w1"] * a["w1"]
            return struct({"b0": (a["g0"] * a11 - a["g1"] * a["w1"]) / det, "b1": (a00 * a["g1"] - a["w1"] * a["g0"]) / det, "c0": a11 / det, "c1": a00 / det})

        def moved(x: Column) -> Column:
            return struct({"b0": x["b0"], "b1": x["b1"], "v0": _expected(x["b0"], x["c0"], SCALES[0]), "v1": _expected(x["b1"], x["c1"], SCALES[1]), "se": F.sqrt(x["c1"])})

        return native._with(struct(sums), lambda q: native._with(weighed(q), lambda a: native._with(solved(a), moved)))

    def null(s: Column, struct) -> Column:
        def solved(p: Column) -> Column:
            w = (n[0] + n[1]) * p * (1 - p)
            a = w + 1 / s["v0"]
            return struct({"b0": (w * s["b0"] + k[0] + k[1] - (n[0] + n[1]) * p) / a, "c0": 1 / a})

        return native._with(_rate(s["b0"]), lambda p: native._with(solved(p), lambda x: struct({"b0": x["b0"], "v0": _expected(x["b0"], x["c0"], SCALES[0])})))

    zero, start = F.lit(0.0), {"v0": F.lit(SCALES[0] ** 2), "v1": F.lit(SCALES[1] ** 2)}
    return _fold({"b0": zero, "b1": zero, **start, "se": zero}, step), _fold({"b0": zero, "v0": start["v0"]}, null)


def loglik(k: Column, n: Column, eta: Column) -> Column:
    """Binomial log-likelihood at log odds eta, without its constant."""
    soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    return k * eta - n * soft


def detection(suff: DataFrame) -> DataFrame:
    """b0, b1, se_b1, stat_detect (twice the gain of the second coefficient at the modes) and df_detect; null and 0 where detection doesn't vary or an arm has no cells."""
    k, n = (F.col("c_ref"), F.col("c_test")), (F.col("n_ref"), F.col("n_test"))
    varies = (k[0] + k[1] > 0) & (k[0] + k[1] < n[0] + n[1]) & (n[0] > 0) & (n[1] > 0)
    full, null = fitted(k, n)
    out = suff.withColumn("_full", F.when(varies, full)).withColumn("_null", F.when(varies, null))
    gain = loglik(k[0], n[0], F.col("_full.b0")) + loglik(k[1], n[1], F.col("_full.b0") + F.col("_full.b1")) - loglik(k[0] + k[1], n[0] + n[1], F.col("_null.b0"))
    return out.withColumns({
        "b0": F.col("_full.b0"), "b1": F.col("_full.b1"), "se_b1": F.col("_full.se"),
        "stat_detect": F.when(varies, F.greatest(F.lit(0.0), 2 * gain)).otherwise(F.lit(0.0)), "df_detect": varies.cast("int"),
    }).drop("_full", "_null")

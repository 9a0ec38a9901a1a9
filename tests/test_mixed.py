import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import mixed
from tidemark.sources.mappings import orders_by_part

DATA = "/root/testdata/sf0.001"
Z = np.linspace(-12, 12, 24001)


def brute(n, k, b, family):
    """Marginal log-likelihood of one gene by the trapezoid rule."""
    total = 0.0
    for nj, kj in zip(n, k, strict=True):
        log_f = -Z * Z / 2 - 0.5 * math.log(2 * math.pi)
        for arm in (0, 1):
            eta = b[0] + b[1] * arm + b[2] * Z
            log_f = log_f + (kj[arm] * eta - nj[arm] * np.logaddexp(0, eta) if family == "binomial" else kj[arm] * eta - nj[arm] * np.exp(eta))
        top = log_f.max()
        total += top + math.log(np.exp(log_f - top).sum() * (Z[1] - Z[0]))
    return total


def drawn(family, genes=12, donors=8, seed=1):
    draw = np.random.default_rng(seed)
    n = draw.integers(15, 60, (genes, donors, 2)).astype(float)
    n[:, 0, 1] = 0  # a donor in one arm only
    eta = -0.7 + draw.normal(0, 0.5, (genes, 1, 1)) * np.arange(2) + draw.choice([0.0, 0.4, 1.0], (genes, 1, 1)) * draw.normal(0, 1, (genes, donors, 1))
    k = draw.binomial(n.astype(int), 1 / (1 + np.exp(-eta))) if family == "binomial" else draw.poisson(n * np.exp(eta))
    return n, k.astype(float)


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_counts_are_at_the_maximum_of_the_integrated_likelihood(family):
    n, k = drawn(family)
    fit = mixed.Counts(n, k, family)
    for null in (False, True):
        b, value, _ = fit.fit(null)
        for g in range(len(n)):
            here = brute(n[g], k[g], b[g], family)
            assert value[g] == pytest.approx(here, abs=5e-5)
            for i in (0, 2) if null else (0, 1, 2):
                for d in (-0.02, 0.02):
                    assert brute(n[g], k[g], b[g] + d * np.eye(3)[i], family) < here + 1e-6


def test_standard_error_is_the_curvature():
    n, k = drawn("binomial", seed=3)
    b, _, se = mixed.Counts(n, k, "binomial").fit(False)
    for g in range(4):
        f = lambda x, g=g: brute(n[g], k[g], b[g] + x, "binomial")
        e, h = np.eye(3), 1e-3
        hessian = np.array([[(f(h * (e[i] + e[j])) - f(h * (e[i] - e[j])) - f(h * (e[j] - e[i])) + f(-h * (e[i] + e[j]))) / (4 * h * h) for j in range(3)] for i in range(3)])
        if b[g, 2] > 0.1:
            assert se[g] == pytest.approx(math.sqrt(np.linalg.inv(-hessian)[1, 1]), rel=0.02)


def test_no_donor_variance_gives_the_plain_test():
    """Without differences between donors the statistic is that of two rates."""
    n = np.full((1, 6, 2), 50.0)
    k = np.broadcast_to([20.0, 30.0], (1, 6, 2)).copy()
    found = mixed._count_test(n, k, "binomial")
    rate = lambda a, m: a * math.log(a / m) + (m - a) * math.log(1 - a / m)
    assert found["sd_donor"][0] == pytest.approx(0, abs=1e-6)
    assert found["stat"][0] == pytest.approx(2 * (rate(120, 300) + rate(180, 300) - rate(300, 600)), rel=1e-8)


def test_gaussian_against_the_full_covariance():
    draw = np.random.default_rng(2)
    donor, arm = np.repeat(np.arange(5), 8), np.tile([0, 0, 0, 1, 1, 1, 1, 0], 5)
    y = 1 + 0.4 * arm + draw.normal(0, 0.7, 5)[donor] + draw.normal(0, 1, 40)
    sums = lambda f: np.array([[[f(y[(donor == d) & (arm == a)]) for a in (0, 1)] for d in range(5)]])
    m, s, q = sums(len).astype(float), sums(np.sum), sums(lambda v: (v * v).sum())
    for null in (False, True):
        beta, value, ratio = mixed.gaussian(m, s, q, null)
        x = np.ones((40, 1)) if null else np.column_stack([np.ones(40), arm])

        def loglik(r, x=x):
            v = np.eye(40) + r * (donor[:, None] == donor)
            w = np.linalg.inv(v)
            b = np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
            rest = (y - x @ b) @ w @ (y - x @ b)
            return -0.5 * (40 * (math.log(2 * math.pi * rest / 40) + 1) + np.linalg.slogdet(v)[1]), b

        grid = np.linspace(0, 3, 1501)
        best = max(loglik(r)[0] for r in grid)
        assert value[0] == pytest.approx(loglik(ratio[0])[0], abs=1e-9) and value[0] >= best - 1e-6
        if not null:
            assert beta[0] == pytest.approx(loglik(ratio[0])[1][1], rel=1e-6)


def test_over_tables(spark):
    m = orders_by_part(spark, DATA)
    rows = mixed.donor_sums(m.expr, m.obs, m.var)
    total = rows.select("celltype", F.explode("donors").alias("d")).groupBy("celltype").agg(F.max("d.n0"), F.sum("d.k0").alias("k0"), F.sum("d.k1").alias("k1"))
    plain = m.expr.join(m.obs, "cell_id").groupBy("celltype").agg(F.count_if(F.col("cond") == 0).alias("k0"), F.count_if(F.col("cond") == 1).alias("k1"))
    assert total.select("celltype", "k0", "k1").orderBy("celltype").collect() == plain.orderBy("celltype").collect()
    for f, names in ((mixed.glmm_detection, mixed.COLUMNS), (mixed.glmm_counts, mixed.COLUMNS)):
        got = f(rows.limit(20)).collect()
        assert len(got) == 20 and list(got[0].asDict()) == ["celltype", "gene", *names] and all(r.stat is None or r.stat >= 0 for r in got)
    hurdle = mixed.glmm_hurdle(rows.limit(20)).collect()
    assert all(r.stat is None or 0 <= r.pvalue <= 1 and r.df in (1, 2) for r in hurdle)
    assert mixed.glmm_hurdle(rows.where("false")).count() == 0
    nobody = m.obs.withColumn("donor", F.lit(None).cast("int"))
    assert mixed.glmm_detection(mixed.donor_sums(m.expr, nobody, m.var)).count() == 0

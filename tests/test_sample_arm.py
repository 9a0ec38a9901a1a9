"""The sample-level arm: outliers, fits against written-out likelihoods, fixed inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions import smooth
from tidemark.operators import nb, pseudobulk

PB = "celltype string, sample string, donor string, cond int, gene string, n long"


def table(spark, counts, cond, donors=None, celltype="T"):
    """A dense sample table from samples x genes counts."""
    n, genes = counts.shape
    donors = [f"d{i}" for i in range(n)] if donors is None else donors
    rows = [(celltype, f"{donors[i]}|{cond[i]}", donors[i], int(cond[i]), f"g{g:03d}", int(counts[i, g])) for i in range(n) for g in range(genes)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in PB.split(", ")]), PB)


@pytest.mark.parametrize("n", [3, 5, 10])
def test_one_wild_sample_makes_no_call(spark, n):
    """Null genes of about 95; in each of eight tables one sample of one gene is 20,000."""
    cond, tables = np.repeat([0, 1], n), []
    for seed in range(8):
        y = np.random.default_rng(seed).negative_binomial(10, 10 / 105, (2 * n, 40))
        y[2 * n - 1, 0] = 20_000
        tables.append(table(spark, y, cond, celltype=f"T{seed}"))
    pb = tables[0]
    for t in tables[1:]:
        pb = pb.unionByName(t)
    found = pseudobulk.test(pb).toPandas()
    wild = found[found.gene == "g000"]
    assert len(wild) == 8 and not (wild.pb_padj < 0.05).any()
    if n < nb.REPLACED:
        assert wild.pb_pvalue.isna().all() and wild.pb_stat.notna().all()
    else:
        assert wild.pb_pvalue.notna().all() and (wild.pb_log2FC.abs() < 1).all()
    rest = found[found.gene != "g000"]
    assert rest.pb_pvalue.notna().mean() > 0.97 and (rest.pb_pvalue < 0.05).mean() < 0.12


def test_a_count_shared_by_three_is_no_outlier():
    y = np.array([[90, 100, 95, 80, 5000, 5200, 5100, 5300.0]]).T
    cond = np.repeat([0, 1], 4)
    found = nb.wald(y, cond, None, np.ones(8), np.array([0.1]), lambda m: np.full(len(m), 0.1), 0.5, 1.0, False)
    assert found["pb_pvalue"][0] < 1e-6


def loglik(y, mu, a):
    return sum(math.lgamma(k + 1 / a) - math.lgamma(1 / a) - math.lgamma(k + 1) + k * math.log(m * a / (1 + m * a)) - math.log(1 + m * a) / a for k, m in zip(y, mu, strict=True))


def test_fits_are_at_the_maximum_of_the_likelihood():
    draw = np.random.default_rng(3)
    cond, size = np.repeat([0, 1], 5), draw.uniform(0.5, 2, 10)
    y = draw.negative_binomial(4, 0.05, (10, 6)).astype(float)
    x = nb.design(cond, None)
    disp = np.array([0.05, 0.1, 0.2, 0.3, 0.5, 1.0])
    beta, mu, cov = nb.fit_means(y, x, size, disp)
    for g in range(6):
        value = lambda b, g=g: loglik(y[:, g], size * np.exp(x @ b), disp[g])
        here = value(beta[g])
        assert all(value(beta[g] + d * np.eye(2)[i]) < here for i in (0, 1) for d in (-0.01, 0.01))
        e, h = np.eye(2), 1e-3
        info = -np.array([[(value(beta[g] + h * (e[i] + e[j])) - value(beta[g] + h * (e[i] - e[j])) - value(beta[g] - h * (e[i] - e[j])) + value(beta[g] - h * (e[i] + e[j]))) / (4 * h * h) for j in (0, 1)] for i in (0, 1)])
        assert cov[g, 1, 1] == pytest.approx(np.linalg.inv(info)[1, 1], rel=0.35)  # observed beside expected information
        w = mu[:, g] / (1 + mu[:, g] * disp[g])
        assert cov[g] == pytest.approx(np.linalg.inv(x.T @ (w[:, None] * x)), rel=1e-4)


def test_dispersions_are_at_the_maximum_of_the_adjusted_likelihood():
    draw = np.random.default_rng(4)
    cond, size = np.repeat([0, 1], 6), np.ones(12)
    y = draw.negative_binomial(3, 0.03, (12, 5)).astype(float)
    x = nb.design(cond, None)
    means, disp = nb.gene_wise(y, x, size)
    assert means == pytest.approx(y.mean(0))
    variance = y.var(0, ddof=1)
    _, mu, _ = nb.fit_means(y, x, size, np.clip((variance - means) / means**2, nb.LEAST_DISP, 10))
    for g in range(5):
        def adjusted(a, g=g):
            w = mu[:, g] / (1 + mu[:, g] * a)
            return loglik(y[:, g], mu[:, g], a) - 0.5 * np.linalg.slogdet(x.T @ (w[:, None] * x))[1]
        grid = np.exp(np.linspace(math.log(1e-4), math.log(10), 4001))
        assert adjusted(disp[g]) >= max(map(adjusted, grid)) - 1e-4


def test_robust_dispersion_by_hand():
    normal = np.array([[10, 12, 11, 30, 33, 36.0]]).T
    # three samples an arm: the middle value, and 2.04 times the middle squared residual
    expected = max(2.04 * np.sort((normal[:3, 0] - 11) ** 2)[1], 2.04 * np.sort((normal[3:, 0] - 33) ** 2)[1])
    assert nb.robust_dispersion(normal, np.repeat([0, 1], 3))[0] == pytest.approx(max((expected - normal.mean()) / normal.mean() ** 2, 0.04))
    wild = normal.copy()
    wild[5] = 1e6
    assert nb.robust_dispersion(wild, np.repeat([0, 1], 3))[0] < 1


def test_size_factors(spark):
    draw = np.random.default_rng(6)
    y = draw.poisson(50, (5, 30)) * np.array([1, 2, 3, 1, 1])[:, None]
    got = {r.sample: r["size"] for r in pseudobulk.size_factors(table(spark, y, [0, 0, 0, 1, 1])).collect()}
    logs = np.log(y)
    expected = np.exp(np.median(logs - logs.mean(0), axis=1))
    assert [got[f"d{i}|{c}"] for i, c in enumerate([0, 0, 0, 1, 1])] == pytest.approx(expected)
    holes = y.copy()
    holes[np.arange(30) % 5, np.arange(30)] = 0
    got = pseudobulk.size_factors(table(spark, holes, [0, 0, 0, 1, 1])).toPandas()
    assert len(got) == 5 and np.log(got["size"]).mean() == pytest.approx(0, abs=1e-9)


def test_trend_of_known_dispersions(spark):
    means = np.exp(np.linspace(0, 8, 200))
    disp = 0.05 + 2 / means
    disp[::50] = 1e4  # far off
    fits = spark.createDataFrame([("T", float(m), float(d)) for m, d in zip(means, disp, strict=True)] + [("few", 3.0, 0.2)], "celltype string, mean double, disp double")
    got = {r.celltype: (r.a0, r.a1) for r in pseudobulk.trends(fits).collect()}
    assert got["T"] == pytest.approx((0.05, 2.0), rel=1e-3) and got["few"] == pytest.approx((0.2, 0.0))


def test_independent_filtering_by_hand(spark):
    draw = np.random.default_rng(8)
    means = np.exp(draw.uniform(0, 6, 300))
    p = np.where((means > 50) & (draw.uniform(size=300) < 0.3), draw.uniform(0, 0.003, 300), draw.uniform(size=300))
    p[:5] = np.nan
    rows = [("T", f"g{i:03d}", float(m), None if math.isnan(v) else float(v)) for i, (m, v) in enumerate(zip(means, p, strict=True))]
    got = pseudobulk.filtered(spark.createDataFrame(rows, "celltype string, gene string, mean double, pb_pvalue double"), 0.1).orderBy("gene").toPandas()
    theta = np.linspace(0, 0.95, 50)
    cuts = np.quantile(means, theta)
    adjusted = [nb.bh(np.where(means >= c, p, np.nan)) for c in cuts]
    rejected = np.array([np.nansum(a < 0.1) for a in adjusted], float)
    line = smooth.lowess(theta, rejected, 1 / 5)
    over = rejected > line.max() - math.sqrt(((rejected - line)[rejected > 0] ** 2).mean())
    assert rejected.max() > 10
    assert got.pb_padj.to_numpy(float) == pytest.approx(adjusted[int(np.argmax(over))], nan_ok=True)


def test_local_lines_of_a_line_and_of_an_outlier():
    x = np.arange(30.0)
    assert smooth.lowess(x, 3 - 2 * x, 0.4) == pytest.approx(3 - 2 * x)
    y = np.sin(x / 5) + np.random.default_rng(0).normal(0, 0.3, 30)
    y[12] += 50
    assert np.abs(smooth.lowess(x, y, 0.4) - np.sin(x / 5)).max() < 1 < np.abs(smooth.lowess(x, y, 0.4, rounds=0) - np.sin(x / 5)).max()


def test_sample_order_and_awkward_names_change_nothing(spark):
    """Six paired donors of noisy counts with donor effects: names in another order, genes with the names of numbers and months."""
    draw = np.random.default_rng(5)
    effect = draw.normal(0, 0.3, 6)
    mean = np.exp(3 + effect[:, None] + np.zeros((6, 60)))
    y = np.concatenate([draw.negative_binomial(5, 5 / (5 + mean)), draw.negative_binomial(5, 5 / (5 + mean * np.exp(1.2 * (np.arange(60) < 6))))])
    cond = np.repeat([0, 1], 6)
    for paired in (False, True):
        a = pseudobulk.test(table(spark, y, cond, [f"d{i % 6}" for i in range(12)]), paired).orderBy("gene").toPandas()
        order = draw.permutation(12)
        b = pseudobulk.test(table(spark, y[order], cond[order], [f"{'zyxwvu'[i % 6]}" for i in order]).withColumn("gene", F.concat(F.lit("MARCH"), "gene")), paired).orderBy("gene").toPandas()
        assert a.pb_log2FC.to_numpy() == pytest.approx(b.pb_log2FC.to_numpy(), abs=1e-4) and a.pb_stat.to_numpy() == pytest.approx(b.pb_stat.to_numpy(), abs=2e-3)
        assert (a.pb_log2FC[:6] > 0.5).all() and a.pb_padj[:6].notna().all() and (a.pb_padj[:6] < 0.05).mean() > 0.6 and (a.pb_padj[6:] < 0.05).mean() < 0.1
        t = pseudobulk.test(table(spark, y, cond, [f"d{i % 6}" for i in range(12)]), paired, use_t=True).orderBy("gene").toPandas()
        assert (t.pb_pvalue >= a.pb_pvalue - 1e-12).all()


def test_arguments_are_checked_before_work(spark):
    obs = spark.createDataFrame([(1, "T", "a", 0)], "cell_id long, celltype string, donor string, cond int")
    counts, var = spark.createDataFrame([(1, "g", 2.0)], "cell_id long, gene string, n double"), spark.createDataFrame([("g",)], "gene string")
    for bad in (lambda: pseudobulk.run_pseudobulk(counts, obs.drop("donor"), var), lambda: pseudobulk.run_pseudobulk(counts.drop("n"), obs, var), lambda: pseudobulk.run_pseudobulk(counts, obs, var, min_gene_counts=-1)):
        with pytest.raises(ValueError):
            bad()
    few = pseudobulk.run_pseudobulk(counts, obs, var, min_cells_per_donor=1).collect()
    assert [(r.gene, r.pb_tested, r.pb_skip_reason, r.n_donors_ref, r.n_donors_test) for r in few] == [("g", False, "need>=2 donors/group (ref=1, test=0)", 1, 0)]


def test_nothing_above_the_count_filter(spark):
    obs = spark.createDataFrame([(i, "T", f"d{i % 4}", int(i % 4 >= 2)) for i in range(8)], "cell_id long, celltype string, donor string, cond int")
    counts, var = spark.createDataFrame([(1, "g", 2.0)], "cell_id long, gene string, n double"), spark.createDataFrame([("g",), ("h",)], "gene string")
    got = pseudobulk.run_pseudobulk(counts, obs, var, min_cells_per_donor=1).collect()
    assert {(r.gene, r.pb_skip_reason, r.pb_tested) for r in got} == {("g", "no_genes_after_count_filter", False), ("h", "no_genes_after_count_filter", False)}

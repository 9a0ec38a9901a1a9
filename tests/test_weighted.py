import numpy as np
import pandas as pd
import pytest
from tidemark.functions import smooth
from tidemark.operators import weighted

SAMPLES, GENES = 8, 40
COND, DONOR = np.tile([0, 1], SAMPLES // 2), np.repeat(np.arange(SAMPLES // 2), 2)


@pytest.fixture(scope="module")
def counts():
    draw = np.random.default_rng(1)
    mean = np.exp(draw.uniform(1, 7, GENES)) * draw.uniform(0.5, 2, (SAMPLES, 1)) * np.exp(draw.normal(0, 0.4, (SAMPLES // 2, GENES)))[DONOR]
    return draw.negative_binomial(5, 5 / (5 + mean)).astype(float)


def rows(spark, counts, **more):
    data = [("T", f"d{DONOR[i]}|{COND[i]}", f"d{DONOR[i]}", int(COND[i]), f"g{g:02d}", int(counts[i, g]), *[float(v[i, g]) for v in more.values()]) for i in range(SAMPLES) for g in range(GENES)]
    return spark.createDataFrame(pd.DataFrame(data, columns=["celltype", "sample", "donor", "cond", "gene", "n", *more]), "celltype string, sample string, donor string, cond int, gene string, n long" + "".join(f", {k} double" for k in more))


def test_library_factors_by_hand(spark, counts):
    got = {r.sample: (r.lib, r.factor) for r in weighted.library_sizes(rows(spark, counts)).collect()}
    x, lib = counts[:, counts.sum(0) > 0], counts.sum(1)
    quartile = np.quantile(x, 0.75, axis=1) / lib
    ref = int(np.argmin(np.abs(quartile - quartile.mean())))
    logs = []
    for i in range(SAMPLES):
        ok = (x[i] > 0) & (x[ref] > 0)
        a, b = x[i, ok] / lib[i], x[ref, ok] / lib[ref]
        ratio, mean, v = np.log2(a / b), (np.log2(a) + np.log2(b)) / 2, (1 - a) / x[i, ok] + (1 - b) / x[ref, ok]
        if np.abs(ratio).max() < 1e-6:
            logs.append(0.0)
            continue
        r1, r2, m = pd.Series(ratio).rank(), pd.Series(mean).rank(), len(ratio)
        keep = ((r1 >= int(m * 0.3) + 1) & (r1 <= m - int(m * 0.3)) & (r2 >= int(m * 0.05) + 1) & (r2 <= m - int(m * 0.05))).to_numpy()
        logs.append((ratio[keep] / v[keep]).sum() / (1 / v[keep]).sum())
    expected = 2 ** (np.array(logs) - np.mean(logs))
    for i in range(SAMPLES):
        assert got[f"d{DONOR[i]}|{COND[i]}"] == pytest.approx((lib[i], expected[i]))


def test_trend_is_the_local_regression_of_all_points(spark):
    draw = np.random.default_rng(2)
    x = np.sort(draw.uniform(0, 10, 120))
    y = 1 + np.exp(-x / 3) + draw.normal(0, 0.05, 120)
    y[60] = 9
    points = spark.createDataFrame([("T", f"g{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "celltype string, gene string, x double, y double")
    r = weighted.trend(points).first()
    places = r["lo"] + r["step"] * np.arange(weighted.PLACES)
    whole = np.interp(places, x, smooth.lowess(x, y, weighted.SPAN))
    assert (r["lo"], places[-1]) == pytest.approx((x[0], x[-1])) and np.abs(np.array(r["curve"]) - whole).max() < 0.01


def test_correlation_and_fit_against_the_full_covariance(spark, counts):
    draw = np.random.default_rng(3)
    y, w = np.log2(counts + 0.5), draw.uniform(0.5, 2, counts.shape)
    table = rows(spark, counts, y=y, w=w)
    x = np.column_stack([np.ones(SAMPLES), COND])
    found = {r.gene: r.rho for r in weighted.correlations(weighted.block_sums(table)).collect()}

    def restricted(rho, g):
        v = np.diag(1 / w[:, g]) + rho / (1 - rho) * (DONOR[:, None] == DONOR)
        if np.linalg.eigvalsh(v).min() <= 0:
            return -np.inf
        inverse = np.linalg.inv(v)
        a = x.T @ inverse @ x
        b = np.linalg.solve(a, x.T @ inverse @ y[:, g])
        rest = (y[:, g] - x @ b) @ inverse @ (y[:, g] - x @ b)
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + (SAMPLES - 2) * np.log(rest))

    for g in range(0, GENES, 5):
        rho = found[f"g{g:02d}"]
        grid = [restricted(r, g) for r in np.linspace(-0.98, 0.99, 198)]
        assert restricted(rho, g) >= np.nanmax(grid) - 1e-3
    agreed = weighted.consensus(spark.createDataFrame([("T", k, v) for k, v in found.items()], "celltype string, gene string, rho double"))
    z = np.sort(np.arctanh(list(found.values())))
    cut = int(GENES * 0.15)
    rho = agreed.first()["rho"]
    assert rho == pytest.approx(np.tanh(z[cut : GENES - cut].mean()))
    fit = {r.gene: r for r in weighted.blocked_fit(table, agreed).collect()}
    same = DONOR[:, None] == DONOR
    for g in range(0, GENES, 7):
        v = np.where(np.eye(SAMPLES, dtype=bool), 1.0, rho * same) / np.sqrt(np.outer(w[:, g], w[:, g]))
        inverse = np.linalg.inv(v)
        cov = np.linalg.inv(x.T @ inverse @ x)
        b = cov @ x.T @ inverse @ y[:, g]
        s2 = (y[:, g] - x @ b) @ inverse @ (y[:, g] - x @ b) / (SAMPLES - 2)
        r = fit[f"g{g:02d}"]
        assert (r.beta, r.s2, r.t) == pytest.approx((b[1], s2, b[1] / np.sqrt(s2 * cov[1, 1])), rel=1e-8)


def test_weighted_fit_by_hand(spark, counts):
    y, w = np.log2(counts + 0.5), np.random.default_rng(4).uniform(0.5, 2, counts.shape)
    fits = weighted.weighted_fit(rows(spark, counts, y=y, w=w))
    got = {r.gene: r for r in weighted.moderated(fits, spark.createDataFrame([("T", 4.0, 0.5)], "celltype string, d0 double, s02 double")).collect()}
    x = np.column_stack([np.ones(SAMPLES), COND])
    for g in range(0, GENES, 9):
        cov = np.linalg.inv(x.T @ (w[:, g, None] * x))
        b = cov @ x.T @ (w[:, g] * y[:, g])
        s2 = (w[:, g] * (y[:, g] - x @ b) ** 2).sum() / (SAMPLES - 2)
        post = (4 * 0.5 + (SAMPLES - 2) * s2) / (4 + SAMPLES - 2)
        r = got[f"g{g:02d}"]
        assert (r.beta, r.s2, r.t, r["df"]) == pytest.approx((b[1], s2, b[1] / np.sqrt(post * cov[1, 1]), SAMPLES - 2 + 4)) and 0 <= r.pvalue <= 1


def test_expressed_genes(spark, counts):
    low = counts.copy()
    low[:, 0] = 0
    low[:, 1] = 1
    low[:4, 2] = 0
    low[4:, 2] = 500
    kept = {r.gene for r in weighted.expressed(rows(spark, low)).select("gene").distinct().collect()}
    lib = low.sum(1)
    cut = 10 / np.median(lib) * 1e6
    expected = {f"g{g:02d}" for g in range(GENES) if (low[:, g] / lib * 1e6 >= cut).sum() >= 4 and low[:, g].sum() >= 15}
    assert kept == expected and "g00" not in kept and "g02" in kept

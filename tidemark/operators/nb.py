"""Negative-binomial fits of genes over samples, in NumPy: all genes of a batch at once.

From the published method: Cox-Reid adjusted dispersions, shrinkage to a trend, IRLS, Wald statistics, and
Cook's distance with a robust dispersion.  What looks over genes (size factors, trend, prior, the
cut of independent filtering) is aggregated by Spark in ``pseudobulk``.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions import special

LEAST_DISP, LN2 = 1e-8, math.log(2.0)
#: Replicates from which on outliers can be found, and from which on they are replaced.
FOUND, REPLACED = 3, 7
#: The robust dispersion isn't below this.
LEAST_ROBUST = 0.04


def design(cond: np.ndarray, donors: list | None) -> np.ndarray:
    """Columns: intercept, condition, and donors but the first."""
    x = np.column_stack([np.ones(len(cond)), cond.astype(float)])
    return x if donors is None else np.column_stack([x, *[[float(d == v) for d in donors] for v in sorted(set(donors))[1:]]])


def estimable(x: np.ndarray) -> bool:
    return len(x) > x.shape[1] and np.linalg.matrix_rank(x) == x.shape[1]


def _log_likelihood(y: np.ndarray, mu: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Per gene, for dispersions a."""
    r = 1.0 / a
    return (special.lgamma(y + r) - special.lgamma(np.broadcast_to(r, y.shape)) + y * np.log(mu * a) - (y + r) * np.log1p(mu * a)).sum(0)


def _adjusted(y, x, mu, log_a, prior=None) -> np.ndarray:
    """Cox-Reid adjusted profile log-likelihood, with a normal prior on log dispersion if given (mean, variance)."""
    a = np.exp(log_a)
    w = mu / (1.0 + mu * a)
    info = np.einsum("ni,ng,nj->gij", x, w, x)
    sign, logdet = np.linalg.slogdet(info)
    out = _log_likelihood(y, mu, a) - 0.5 * np.where(sign > 0, logdet, 0.0)
    return out if prior is None else out - (log_a - prior[0]) ** 2 / (2 * prior[1])


def _maximise(y, x, mu, low, high, prior=None, rounds: int = 4, points: int = 17) -> np.ndarray:
    """Log dispersions by grid search narrowed around the best point, all genes at once, then the top of a parabola through three points."""
    a, b = np.full(y.shape[1], low), np.full(y.shape[1], high)
    for _ in range(rounds):
        grid = np.linspace(a, b, points)
        value = np.stack([_adjusted(y, x, mu, g, prior) for g in grid])
        k, at, step = np.nanargmax(value, axis=0), np.arange(y.shape[1]), (b - a) / (points - 1)
        best = grid[k, at]
        a, b = np.maximum(best - step, low), np.minimum(best + step, high)
    below, here, above = (value[np.clip(k + d, 0, points - 1), at] for d in (-1, 0, 1))
    bend = below - 2 * here + above
    inside = (k > 0) & (k < points - 1) & (bend < -1e-9)
    return best + np.where(inside, step * 0.5 * (below - above) / np.where(inside, bend, 1.0), 0.0)


def fit_means(y: np.ndarray, x: np.ndarray, size: np.ndarray, a: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients genes x p, means, covariance genes x p x p) at given dispersions, by IRLS with a slight ridge."""
    p, genes = x.shape[1], y.shape[1]
    ridge = np.eye(p) * 1e-6
    beta = np.zeros((genes, p))
    beta[:] = np.linalg.lstsq(x, np.log(y / size[:, None] + 0.1), rcond=None)[0].T
    old = np.full(genes, np.inf)
    for _ in range(steps):
        mu = np.maximum(size[:, None] * np.exp(np.clip(x @ beta.T, -30, 30)), 0.5)
        w = mu / (1.0 + mu * a)
        z = np.log(mu / size[:, None]) + (y - mu) / mu
        info = np.einsum("ni,ng,nj->gij", x, w, x) + ridge
        beta = np.linalg.solve(info, np.einsum("ni,ng->gi", x, w * z)[:, :, None])[:, :, 0]
        deviance = -2 * _log_likelihood(y, mu, a)
        if np.all(np.abs(deviance - old) / (np.abs(deviance) + 0.1) < 1e-12):
            break
        old = deviance
    mu = np.maximum(size[:, None] * np.exp(np.clip(x @ beta.T, -30, 30)), 0.5)
    w = mu / (1.0 + mu * a)
    plain = np.einsum("ni,ng,nj->gij", x, w, x)
    inverse = np.linalg.inv(plain + ridge)
    return beta, mu, inverse @ plain @ inverse


def bounds(n: int) -> tuple[float, float]:
    """Of a log dispersion."""
    return math.log(LEAST_DISP), math.log(max(10.0, n))


def gene_wise(y: np.ndarray, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of normalised counts, and dispersions by likelihood at the means of a first fit."""
    normal = y / size[:, None]
    means, variance = normal.mean(0), normal.var(0, ddof=1)
    rough = np.clip((variance - (1 / size).mean() * means) / np.maximum(means, 1e-8) ** 2, LEAST_DISP, 10.0)
    _, mu, _ = fit_means(y, x, size, rough)
    return means, np.exp(_maximise(y, x, mu, *bounds(len(y))))


def shrunk(y: np.ndarray, x: np.ndarray, size: np.ndarray, disp: np.ndarray, fitted: np.ndarray, width: float, spread: float) -> np.ndarray:
    """Dispersions drawn to the trend; those far above it stay."""
    _, mu, _ = fit_means(y, x, size, disp)
    drawn = np.exp(_maximise(y, x, mu, *bounds(len(y)), (np.log(fitted), width)))
    return np.where(np.log(disp) > np.log(fitted) + 2 * spread, disp, drawn)


def _trimmed(v: np.ndarray, share: float) -> np.ndarray:
    """Means down the columns without ``share`` of the values at either end."""
    cut = int(len(v) * share + 1e-9)
    return np.sort(v, axis=0)[cut : len(v) - cut].mean(0)


def robust_dispersion(normal: np.ndarray, arm: np.ndarray | None) -> np.ndarray:
    """By moments from trimmed variances: within the arms, the greatest of them, where an arm has three samples; else over all samples."""
    means = normal.mean(0)
    found = []
    for k in () if arm is None else np.unique(arm):
        part = normal[arm == k]
        if len(part) >= FOUND:
            # shares to trim, and what makes trimmed squares of normal deviates unbiased, by the number of samples (fixed values)
            share, scale = (1 / 3, 2.04) if len(part) <= 3 else (1 / 4, 1.86) if len(part) <= 23 else (1 / 8, 1.51)
            found.append(scale * _trimmed((part - _trimmed(part, share)) ** 2, share))
    variance = np.max(found, axis=0) if found else 1.51 * _trimmed((normal - _trimmed(normal, 1 / 8)) ** 2, 1 / 8)
    return np.maximum((variance - means) / np.maximum(means, 1e-8) ** 2, LEAST_ROBUST)


def cooks(y: np.ndarray, x: np.ndarray, size: np.ndarray, mu: np.ndarray, disp: np.ndarray, arm: np.ndarray | None) -> np.ndarray:
    """Cook's distance of each sample: leverage by the fit's dispersion, the residual's variance by the robust one, which an outlier doesn't move."""
    w = mu / (1 + mu * disp)
    hat = np.einsum("ni,gij,nj->ng", x, np.linalg.inv(np.einsum("ni,ng,nj->gij", x, w, x)), x) * w
    variance = mu + robust_dispersion(y / size[:, None], arm) * mu**2
    return (y - mu) ** 2 / variance / x.shape[1] * hat / np.maximum(1 - hat, 1e-8) ** 2


def wald(y: np.ndarray, cond: np.ndarray, donors: list | None, size: np.ndarray, disp: np.ndarray, trend, width: float, spread: float, use_t: bool) -> dict[str, np.ndarray]:
    """Statistics of genes with counts; ``trend``: from means to dispersions.

    A sample that alone moves the fit costs its gene the p where its arm has three to six samples, unless
    three samples have larger counts; where it has seven, its count is replaced by the trimmed mean, and the gene is fitted again.
    """
    x = design(cond, donors)
    n, p = x.shape
    means = (y / size[:, None]).mean(0)
    final = shrunk(y, x, size, disp, trend(means), width, spread)
    beta, mu, cov = fit_means(y, x, size, final)
    flagged, replaced = np.zeros(y.shape[1], bool), np.zeros(y.shape[1], bool)
    replicates = np.array([(cond == c).sum() for c in cond]) if donors is None else np.ones(n)
    if (replicates >= FOUND).any() and n > p:
        limit = f_quantile_99(p, n - p)
        distance = cooks(y, x, size, mu, final, cond)
        again = replicates >= REPLACED
        out = (distance > limit) & again[:, None]
        replaced = out.any(0)
        if replaced.any():
            typical = _trimmed(y[:, replaced] / size[:, None], 0.2) * size[:, None]
            part = np.where(out[:, replaced], np.floor(typical), y[:, replaced])
            new_means, new = gene_wise(part, x, size)
            some = part.sum(0) > 0
            at = np.flatnonzero(replaced)[some]
            new = shrunk(part[:, some], x, size, new[some], trend(new_means[some]), width, spread)
            beta[at], mu[:, at], cov[at] = fit_means(part[:, some], x, size, new)
            distance[:, at] = cooks(part[:, some], x, size, mu[:, at], new, cond)
            means[replaced] = new_means
            final[at] = new
        seen = np.where(((replicates >= FOUND) & ~again)[:, None] | (~replaced & (replicates >= FOUND)[:, None]), distance, 0.0)
        most = seen.argmax(0)
        larger = (y > y[most, np.arange(y.shape[1])]).sum(0)
        flagged = (seen.max(0) > limit) & (larger < 3)
    z = beta[:, 1] / np.sqrt(np.maximum(cov[:, 1, 1], 1e-300))
    log_p = special.t_log_two_sided(z, float(n - p)) if use_t else special.log_erfc(np.abs(z) / math.sqrt(2.0))
    lost = lambda v: np.where(flagged, np.nan, v)
    return {"mean": means, "dispersion": final, "pb_log2FC": beta[:, 1] / LN2, "pb_stat": z, "pb_pvalue": lost(np.exp(log_p)), "pb_neglog10p": lost(-log_p / special.LN10), "replaced": replaced.astype(float)}


def f_quantile_99(a: int, b: int) -> float:
    """99 % quantile of the F distribution by bisection on the incomplete beta function."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        x = b / (b + a * mid)  # P(F > mid) = I_x(b/2, a/2)
        if x < (b / 2 + 1) / ((a + b) / 2 + 2):
            tail = math.exp(float(special.log_betainc(b / 2, a / 2, math.log(x), math.log1p(-x))[0]))
        else:
            tail = 1 - math.exp(float(special.log_betainc(a / 2, b / 2, math.log1p(-x), math.log(x))[0]))
        low, high = (mid, high) if tail > 0.01 else (low, mid)
    return high


def bh(p: np.ndarray) -> np.ndarray:
    out, ok = np.full(len(p), np.nan), ~np.isnan(p)
    order = np.argsort(p[ok], kind="stable")
    q = p[ok][order] * ok.sum() / np.arange(1, ok.sum() + 1)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1.0)
    back = np.empty_like(q)
    back[order] = q
    out[ok] = back
    return out

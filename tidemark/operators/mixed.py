"""Donor random effects: tests of the condition where cells of a donor are alike.

Cells aren't fitted.  A hash aggregate gives, for each gene, donor and arm, the number of cells, of cells
that detect the gene, and sums over them; a gene's donors then are one row, and rows are fitted in
Arrow batches, all genes of a batch at once.

* *Counts* (detection: binomial; counts: Poisson).  The linear predictor is b0 + b1 * arm + s * z with
  z standard normal, one a donor.  A donor's integral over z is an adaptive Gauss-Hermite sum around its mode.
  Steps are of two kinds, in fixed number: first the maximum of the expected complete likelihood, one scoring step each,
  then Newton steps with Louis' observed information; where that isn't positive definite, the first kind again.
  s = 0 is an inner point of this parametrisation, so a vanishing donor variance is reached, not crept up to.
* *Expression* (Gaussian, of the cells that detect the gene).  For a ratio of donor to residual variance the
  likelihood is closed in sums a donor and arm; the ratio is found by grids, each around the best point of the one before.

What a donor's cells number doesn't matter to the cost; a batch holds genes x donors x nodes numbers,
and its genes are cut so that these stay below ``CELLS``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .dealing import deal

NODES = 15
SCORING, NEWTON, MODE_STEPS = 12, 14, 2
#: A step moves no parameter further.
LONGEST = 2.0
START_S = 0.5
#: Numbers in a working array.
CELLS = 2_000_000
GRID, GRIDS = 33, 4
MOST_RATIO = 0.999


def donor_sums(expr: DataFrame, obs: DataFrame, var: DataFrame, value: str = "value", count: str = "n") -> DataFrame:
    """celltype, gene, donors: an array with a struct a donor: cells n, detected k, counts y, sums s and squares q of ``value`` by arm."""
    keys = ["celltype", "donor"]
    v, arm = F.col(value), lambda j, c: F.when(F.col("cond") == j, c)
    sizes = obs.where(F.col("donor").isNotNull()).groupBy(*keys).agg(*[F.count(arm(j, F.lit(1))).alias(f"n{j}") for j in (0, 1)])
    x = expr.where(v > 0).join(obs.select("cell_id", *keys, "cond"), "cell_id").groupBy("celltype", "gene", "donor")
    sums = [f(arm(j, c)).alias(f"{name}{j}") for j in (0, 1) for name, f, c in (("k", F.count, F.lit(1)), ("y", F.sum, F.col(count).cast("double")), ("s", F.sum, v), ("q", F.sum, v * v))]
    names = [f"{c}{j}" for c in "kysq" for j in (0, 1)]
    every = sizes.crossJoin(var.select("gene")).join(x.agg(*sums), ["celltype", "gene", "donor"], "left").fillna(0, names)
    return every.groupBy("celltype", "gene").agg(F.array_sort(F.collect_list(F.struct("donor", "n0", "n1", *names))).alias("donors"))


class Counts:
    """Fits of a family over genes x donors arrays: trials n, successes or counts k, both with a last axis for the arm."""

    def __init__(self, n: np.ndarray, k: np.ndarray, family: str):
        self.n, self.k, self.family = n[:, :, None, :], k[:, :, None, :], family
        x, w = np.polynomial.hermite.hermgauss(NODES)
        self.x, self.log_w = x, np.log(w) + x * x

    def _at(self, b: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of the arms, residuals and information (last axis: arm) at z (genes, donors, points)."""
        eta = np.clip(b[:, None, None, 0:1] + b[:, None, None, 1:2] * np.arange(2) + (b[:, 2, None, None] * z)[..., None], -30, 30)
        if self.family == "binomial":
            p = 1.0 / (1.0 + np.exp(-eta))
            return (self.k * eta - self.n * np.logaddexp(0.0, eta)).sum(-1), self.k - self.n * p, self.n * p * (1 - p)
        mean = self.n * np.exp(eta)
        return (self.k * eta - mean).sum(-1), self.k - mean, mean

    def _modes(self, b: np.ndarray, z: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Modes of z after Newton steps, and the curvature there."""
        s = b[:, 2, None, None]
        for _ in range(steps):
            _, r, v = self._at(b, z)
            z = z + np.clip((s * r.sum(-1) - z) / (s * s * v.sum(-1) + 1), -LONGEST, LONGEST)
        return z, s * s * self._at(b, z)[2].sum(-1) + 1

    def _posterior(self, b: np.ndarray, z: np.ndarray, steps: int):
        """Modes; log-likelihood a gene; and at the nodes: z, weights that add up to 1 a donor, residuals, information."""
        z, h = self._modes(b, z, steps)
        nodes = z + np.sqrt(2.0 / h) * self.x
        ll, r, v = self._at(b, nodes)
        log_f = ll - nodes**2 / 2 + self.log_w
        top = log_f.max(-1, keepdims=True)
        f = np.exp(log_f - top)
        total = f.sum(-1, keepdims=True)
        value = (top + np.log(total) + 0.5 * np.log(2.0 / h) - 0.5 * math.log(2 * math.pi))[..., 0].sum(1)
        return z, value, nodes, f / total, r, v

    def fit(self, null: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(b0, b1, |s|), log-likelihood, standard error of b1, of each gene; ``null``: b1 = 0."""
        free = [0, 2] if null else [0, 1, 2]
        n, k = self.n[:, :, 0].sum(1), self.k[:, :, 0].sum(1)
        if null:
            n, k = n.sum(1, keepdims=True), k.sum(1, keepdims=True)
        rate = np.log((k + 0.5) / (n - k + 0.5)) if self.family == "binomial" else np.log((k + 0.5) / (n + 0.5))
        b = np.column_stack([rate[:, 0], rate[:, -1] - rate[:, 0], np.full(len(rate), START_S)])
        z = np.zeros((len(b), self.n.shape[1], 1))
        for step in range(SCORING + NEWTON):
            z, _, *at = self._posterior(b, z, MODE_STEPS)
            gradient, expected, observed = self._moments(*at)
            info = expected if step < SCORING else np.where(_definite(observed, free)[:, None, None], observed, expected)
            b[:, free] += np.clip(np.linalg.solve(info[:, free][:, :, free], gradient[:, free, None])[..., 0], -LONGEST, LONGEST)
        z, value, *at = self._posterior(b, z, MODE_STEPS)
        _, expected, observed = self._moments(*at)
        good = _definite(observed, free)
        inverse = np.linalg.inv(np.where(good[:, None, None], observed, expected)[:, free][:, :, free])
        se = np.where(good, np.sqrt(np.maximum(inverse[:, 1, 1], 0)), np.nan)
        b[:, 2] = np.abs(b[:, 2])
        return b, value, se

    @staticmethod
    def _moments(z, w, r, v):
        """Gradient, expected complete information and observed information (genes, 3, 3), a little added on the diagonal."""
        score = np.stack([r.sum(-1), r[..., 1], z * r.sum(-1)], -1)
        mean = np.einsum("gdq,gdqi->gdi", w, score)
        d = np.stack([np.ones_like(z), np.zeros_like(z), z], -1)
        info = np.einsum("gdq,gdq,gdqi,gdqj->gij", w, v[..., 0], d, d, optimize=True)
        d[..., 1] = 1
        info += np.einsum("gdq,gdq,gdqi,gdqj->gij", w, v[..., 1], d, d, optimize=True) + 1e-9 * np.eye(3)
        spread = np.einsum("gdq,gdqi,gdqj->gij", w, score, score, optimize=True) - np.einsum("gdi,gdj->gij", mean, mean)
        return mean.sum(1), info, info - spread


def _definite(m: np.ndarray, free: list[int]) -> np.ndarray:
    """Whether the leading minors of the free part are positive."""
    part = m[:, free][:, :, free]
    return np.logical_and.reduce([np.linalg.det(part[:, :k, :k]) > 0 for k in range(1, len(free) + 1)])


def gaussian(m: np.ndarray, s: np.ndarray, q: np.ndarray, null: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(difference of the arms, log-likelihood, variance ratio) by maximum likelihood; m, s, q: genes x donors x arms."""
    total = m.sum((1, 2))
    low, high = np.zeros(len(m)), np.full(len(m), MOST_RATIO)
    best = None
    for _ in range(GRIDS):
        rho = np.linspace(low, high, GRID).T
        ratio = (rho / (1 - rho))[:, :, None]
        here, sums = m.sum(2)[:, None, :], s.sum(2)[:, None, :]
        c = ratio / (1 + ratio * here)
        x = [(here, sums)] if null else [(here, sums), (m[:, None, :, 1], s[:, None, :, 1])]
        a = np.stack([np.stack([((np.minimum(u, v) if i != j else u) - c * u * v).sum(2) for j, (v, _) in enumerate(x)], -1) for i, (u, _) in enumerate(x)], -2)
        y = np.stack([(t - c * u * sums).sum(2) for u, t in x], -1)
        beta = np.linalg.solve(a, y[..., None])[..., 0]
        rest = np.maximum(q.sum((1, 2))[:, None] - (c * sums**2).sum(2) - (beta * y).sum(-1), 1e-300)
        value = -0.5 * (total[:, None] * (np.log(2 * np.pi * rest / total[:, None]) + 1) + np.log1p(ratio * here).sum(2))
        at = value.argmax(1)
        pick = np.arange(len(m))
        best = beta[pick, at, -1], value[pick, at], rho[pick, at]
        step = (high - low) / (GRID - 1)
        low, high = np.maximum(best[2] - step, 0), np.minimum(best[2] + step, MOST_RATIO)
    return best[0], best[1], best[2] / (1 - best[2])


def _arrays(column: pa.ListArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Fields of a list of structs as rows x longest arrays, zeros at the end of shorter ones."""
    size = np.diff(column.offsets.to_numpy())
    flat, width = column.flatten(), int(size.max(initial=0))
    inside = np.arange(width) < size[:, None]
    out = {}
    for k, field in enumerate(flat.type):
        if not pa.types.is_string(field.type) and field.name != "donor":
            wide = np.zeros(inside.shape)
            wide[inside] = flat.field(k).to_numpy(zero_copy_only=False)
            out[field.name] = wide
    return out, size


def _fitted(rows: DataFrame, fit, names: list[str]) -> DataFrame:
    """``fit`` of the arrays of some genes at a time; columns of doubles, NaN as null."""

    def run(batches):
        for b in batches:
            width = max(int(np.diff(b.column("donors").offsets.to_numpy()).max(initial=1)), 1)
            step = max(1, CELLS // (width * max(GRID, NODES * 2)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                donors = part.column("donors")
                values, _ = _arrays(pa.ListArray.from_arrays(pa.array(donors.offsets.to_numpy() - donors.offsets[0].as_py()), donors.flatten()))
                with np.errstate(all="ignore"):
                    found = fit(values)
                yield pa.RecordBatch.from_arrays([part.column("celltype"), part.column("gene"), *[pa.array(found[c], pa.float64(), from_pandas=True) for c in names]], ["celltype", "gene", *names])

    return deal(rows.select("celltype", "gene", "donors"), "celltype", "gene").mapInArrow(run, "celltype string, gene string, " + ", ".join(f"{c} double" for c in names))


def _stacked(values: dict[str, np.ndarray], name: str) -> np.ndarray:
    return np.stack([values[f"{name}0"], values[f"{name}1"]], -1)


def _count_test(n: np.ndarray, k: np.ndarray, family: str) -> dict[str, np.ndarray]:
    fit = Counts(n, k, family)
    b, full, se = fit.fit(False)
    null_b, null, _ = fit.fit(True)
    some = (k.sum((1, 2)) > 0) & (n.sum(1) > 0).all(1)
    if family == "binomial":
        some &= k.sum((1, 2)) < n.sum((1, 2))
    arms = k.sum(1)
    # an arm of all or nothing: the likelihood has a supremum, but no coefficients reach it
    reached = some & (arms > 0).all(1) & ((arms < n.sum(1)).all(1) if family == "binomial" else True)
    only = lambda x, ok=some: np.where(ok, x, np.nan)
    return {"b0": only(b[:, 0], reached), "beta": only(b[:, 1], reached), "sd_donor": only(b[:, 2]), "se": only(se, reached), "loglik": only(full), "loglik_null": only(null), "sd_donor_null": only(null_b[:, 2]), "stat": only(np.maximum(2 * (full - null), 0.0))}


COLUMNS = ["b0", "beta", "sd_donor", "se", "loglik", "loglik_null", "sd_donor_null", "stat"]


def glmm_detection(rows: DataFrame) -> DataFrame:
    """Logistic random-intercept test of detection, of ``donor_sums``: celltype, gene, and COLUMNS.

    All are null where detection doesn't vary or an arm has no cells, coefficients also where an arm is all or nothing.
    """
    return _fitted(rows, lambda v: _count_test(_stacked(v, "n"), _stacked(v, "k"), "binomial"), COLUMNS)


def glmm_counts(rows: DataFrame) -> DataFrame:
    """Poisson random-intercept test of the raw counts, of ``donor_sums``."""
    return _fitted(rows, lambda v: _count_test(_stacked(v, "n"), _stacked(v, "y"), "poisson"), COLUMNS)


def glmm_hurdle(rows: DataFrame) -> DataFrame:
    """Detection and expression, both with a random intercept a donor: statistics, degrees of freedom, tails.

    Expression takes part where both arms have cells that detect the gene, three at least in all, and residuals vary.
    """

    def fit(v):
        found = _count_test(_stacked(v, "n"), _stacked(v, "k"), "binomial")
        m, s, q = (_stacked(v, c) for c in "ksq")
        arms = m.sum(1)
        rest = q.sum((1, 2)) - np.where(arms > 0, s.sum(1) ** 2 / np.maximum(arms, 1), 0).sum(1)
        use = (arms > 0).all(1) & (arms.sum(1) > 2) & (rest > 1e-10 * q.sum((1, 2)))
        safe = lambda x: np.where(use[:, None, None], x, 1.0)
        beta, full, ratio = gaussian(safe(m), safe(s), safe(q) + ~use[:, None, None], False)
        _, null, _ = gaussian(safe(m), safe(s), safe(q) + ~use[:, None, None], True)
        detect = np.isfinite(found["stat"])
        stat = np.where(detect, found["stat"], 0) + np.where(use, np.maximum(2 * (full - null), 0), 0)
        df = detect.astype(float) + use
        some = df > 0
        log_p = special.chi2_log_sf(stat, np.maximum(df, 1))
        only = lambda ok, x: np.where(ok, x, np.nan)
        return {
            "stat_detect": found["stat"], "beta_detect": found["beta"], "sd_detect": found["sd_donor"], "stat_continuous": only(use, np.maximum(2 * (full - null), 0)),
            "beta_continuous": only(use, beta), "ratio_continuous": only(use, ratio), "stat": only(some, stat), "df": only(some, df), "pvalue": only(some, np.exp(log_p)), "neglog10p": only(some, -log_p / special.LN10),
        }

    return _fitted(rows, fit, ["stat_detect", "beta_detect", "sd_detect", "stat_continuous", "beta_continuous", "ratio_continuous", "stat", "df", "pvalue", "neglog10p"])

"""Robust local regression of a few points, from the published algorithm."""

from __future__ import annotations

import numpy as np


def tricube(r: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Weights of distances r at bandwidth h: 1 up to a thousandth of it, none from .999 of it on (fixed values of the method)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (1 - (r / h) ** 3) ** 3
    return np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, w, 0.0))


def lowess(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 3) -> np.ndarray:
    """Fitted values at sorted x: local lines over the nearest ``share`` of the points, then ``rounds`` of bisquare weights of the residuals."""
    n = len(x)
    k = max(min(n, int(share * n + 1e-7)), 2)
    apart = np.abs(x[:, None] - x)
    h = np.sort(apart, axis=1)[:, k - 1 : k]
    near = tricube(apart, h)
    trust, fit = np.ones(n), y.astype(float)
    for _ in range(rounds + 1):
        w = near * trust
        total = w.sum(1, keepdims=True)
        w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
        center = (w * x).sum(1)
        spread = (w * (x - center[:, None]) ** 2).sum(1)
        steep = np.sqrt(spread) > 0.001 * (x[-1] - x[0])
        slope = np.divide((w * (x - center[:, None]) * y).sum(1), spread, out=np.zeros(n), where=steep)
        fit = np.where(total[:, 0] > 0, (w * y).sum(1) + slope * (x - center), y)
        rest = np.abs(y - fit)
        scale = 6 * np.median(rest)
        if scale < 1e-7 * rest.mean() or scale == 0:
            break
        trust = np.where(rest <= 0.001 * scale, 1.0, np.where(rest <= 0.999 * scale, (1 - (rest / scale) ** 2) ** 2, 0.0))
    return fit

import math

import numpy as np
import pytest
from tidemark.operators import penalised

ROWS = [("plain", 30, 100, 50, 90), ("all in one arm", 20, 20, 5, 30), ("none in one arm", 0, 40, 12, 40), ("apart", 0, 25, 25, 25), ("large", 30_000, 100_000, 31_000, 99_000), ("never", 0, 10, 0, 10), ("no cells", 3, 10, 0, 0)]


def steps(k, n, count):
    """The same steps by matrices."""
    x, b, v = np.array([[1.0, 0.0], [1.0, 1.0]]), np.zeros(2), np.array(penalised.SCALES) ** 2
    for _ in range(count):
        p = 1 / (1 + np.exp(-x @ b))
        w = n * p * (1 - p)
        z = x @ b + (k - n * p) / w
        inverse = np.linalg.inv(x.T @ (w[:, None] * x) + np.diag(1 / v))
        b = inverse @ (x.T @ (w * z))
        v = (b**2 + np.diag(inverse) + np.array(penalised.SCALES) ** 2) / 2
    return b, math.sqrt(inverse[1, 1]), inverse, w, v


def test_fold_against_matrices(spark):
    df = spark.createDataFrame(ROWS, "gene string, c_ref long, n_ref long, c_test long, n_test long")
    got = {r.gene: r for r in penalised.detection(df).collect()}
    for name, k0, n0, k1, n1 in ROWS[:5]:
        k, n = np.array([k0, k1], float), np.array([n0, n1], float)
        b, se, inverse, w, v = steps(k, n, 1000)
        assert (got[name].b0, got[name].b1) == pytest.approx(tuple(b), rel=1e-5, abs=1e-6) and got[name].se_b1 == pytest.approx(se, rel=1e-5)
        # a fixed point: the penalised score vanishes
        p = 1 / (1 + np.exp(-np.array([b[0], b[0] + b[1]])))
        score = np.array([(k - n * p).sum(), (k - n * p)[1]]) - b / v
        assert np.abs(score).max() < 1e-6 * n.sum()
        assert all(math.isfinite(x) for x in (got[name].b0, got[name].b1, got[name].stat_detect)) and got[name].df_detect == 1
    assert got["large"].b1 == pytest.approx(math.log(31 / 68 / (30 / 70)), abs=1e-3)
    assert got["apart"].stat_detect > 40 and abs(got["apart"].b1) < 12
    for name in ("never", "no cells"):
        assert got[name].df_detect == 0 and got[name].stat_detect == 0 and got[name].b1 is None


def test_statistic_is_near_the_plain_one_with_many_cells(spark):
    df = spark.createDataFrame(ROWS[4:5], "gene string, c_ref long, n_ref long, c_test long, n_test long")
    r = penalised.detection(df).first()
    rate = lambda a, m: a * math.log(a / m) + (m - a) * math.log(1 - a / m)
    assert r.stat_detect == pytest.approx(2 * (rate(30_000, 100_000) + rate(31_000, 99_000) - rate(61_000, 199_000)), rel=1e-3)


def test_no_python_on_executors(spark):
    df = spark.createDataFrame(ROWS, "gene string, c_ref long, n_ref long, c_test long, n_test long")
    plan = penalised.detection(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("BatchEvalPython", "ArrowEval", "MapIn"))

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import native, special


def run(spark, f, *columns):
    """``f`` of columns of numbers."""
    rows = [tuple(float(c[i]) for c in columns) for i in range(len(columns[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(len(columns)))).coalesce(1)
    return np.array([r[0] for r in df.select(f(*[F.col(f"c{k}") for k in range(len(columns))])).collect()], float)


def test_tails_of_one_and_two_degrees(spark):
    x = np.concatenate([[0, 1e-12, 1e-3], np.geomspace(0.01, 1e5, 60)])
    for df in (1, 2):
        got = run(spark, lambda s, df=df: native.chi2_log_tail(s, F.lit(df)), x)
        assert got == pytest.approx(special.chi2_log_sf(x, df), rel=1e-12, abs=1e-13)
    assert run(spark, lambda s: native.chi2_log_tail(s, F.lit(3)), [1.0])[0] != run(spark, lambda s: native.chi2_log_tail(s, F.lit(2)), [1.0])[0]


def test_gamma_functions(spark):
    x = np.concatenate([np.arange(0.5, 12, 0.5), np.geomspace(0.01, 1e6, 30)])
    assert run(spark, native.log_gamma, x) == pytest.approx(special.lgamma(x), rel=1e-12, abs=1e-11)
    assert run(spark, native.digamma, x) == pytest.approx(special.digamma(x), rel=1e-11, abs=1e-11)
    assert run(spark, native.trigamma, x) == pytest.approx(special.trigamma(x), rel=1e-11)
    y = np.geomspace(1e-5, 50, 30)
    assert run(spark, native.trigamma_inverse, y) == pytest.approx(special.trigamma_inverse(y), rel=1e-9)


def test_t_tails_and_back(spark):
    t, df = (a.ravel() for a in np.meshgrid([0, 0.01, 0.5, 1, 2, 5, 12, 40], [1, 2, 3.5, 10, 47.3, 300, 5e4, 1e6]))
    got = run(spark, native.t_log_two_sided, t, df)
    assert got == pytest.approx(special.t_log_two_sided(t, df), rel=1e-9, abs=1e-9)
    lp = -np.geomspace(1e-6, 5e4, 50)
    z = np.sqrt(run(spark, native.chi2_of_log_tail, lp))
    assert special.log_erfc(z / np.sqrt(2)) == pytest.approx(lp, rel=1e-9)
    assert run(spark, native.chi2_of_log_tail, [0.0])[0] == 0


def test_no_python_on_executors(spark):
    df = spark.range(5).select(native.t_log_two_sided(F.col("id"), F.lit(3)), native.chi2_of_log_tail(-F.col("id")), native.trigamma_inverse(F.col("id") + 1))
    assert not any(w in df._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))

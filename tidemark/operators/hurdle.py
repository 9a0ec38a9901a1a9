"""The two-part test of two groups in closed form: sufficient statistics, then Column algebra.

One hash aggregate gives counts, sums and sums of squares a cell type and gene; detection is a
G-test of the rates, expression a likelihood-ratio test of the positives' means.  No fit, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..schema import xlogy

#: Residual sums of squares up to this share of the sum of squares are rounding noise.
NOISE = 1e-10


def sufficient(expr: DataFrame, obs: DataFrame, value: str = "value") -> DataFrame:
    """celltype, gene and, for each arm, positives c, sum s, sum of squares q.  Values of zero and below count as not detected."""
    v = F.col(value)
    x = expr.where(v > 0).join(obs.select("cell_id", F.col("celltype").cast("string").alias("celltype"), "cond"), "cell_id")
    arm = lambda k, c: F.when(F.col("cond") == k, c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.groupBy("celltype", "gene").agg(
        F.count_if(F.col("cond") == 0).alias("c_ref"), F.count_if(F.col("cond") == 1).alias("c_test"),
        zero(F.sum(arm(0, v))).alias("s_ref"), zero(F.sum(arm(1, v))).alias("s_test"),
        zero(F.sum(arm(0, v * v))).alias("q_ref"), zero(F.sum(arm(1, v * v))).alias("q_test"),
    )


def densify(suff: DataFrame, sizes: DataFrame, var: DataFrame) -> DataFrame:
    """A row for every cell type and gene; genes that no cell of a type has get zeros."""
    every = sizes.crossJoin(var.select("gene"))
    filled = every.join(suff, ["celltype", "gene"], "left")
    return filled.fillna(0, ["c_ref", "c_test"]).fillna(0.0, ["s_ref", "s_test", "q_ref", "q_test"])


def describe(suff: DataFrame) -> DataFrame:
    """Rates and means over all cells, zeros among them, and whether an arm is all or nothing."""
    c, n = {k: F.col(f"c_{k}") for k in ("ref", "test")}, {k: F.col(f"n_{k}") for k in ("ref", "test")}
    out = suff.withColumn("n_positive", c["ref"] + c["test"])
    for k in ("ref", "test"):
        out = out.withColumn(f"detect_rate_{k}", F.try_divide(c[k], n[k])).withColumn(f"mean_expr_{k}", F.try_divide(f"s_{k}", n[k]))
    separated = (c["ref"] == 0) | (c["ref"] == n["ref"]) | (c["test"] == 0) | (c["test"] == n["test"])
    return out.withColumn("detection_separated", separated)


def detection(suff: DataFrame) -> DataFrame:
    """stat_detect and df_detect: twice the gain in log-likelihood of a rate an arm over one rate."""
    cr, ct, nr, nt = (F.col(k).cast("double") for k in ("c_ref", "c_test", "n_ref", "n_test"))
    p, n = cr + ct, nr + nt
    part = lambda k, m: xlogy(k, k / m) + xlogy(m - k, 1 - k / m)
    varies = (p > 0) & (p < n) & (nr > 0) & (nt > 0)
    gain = 2 * (part(cr, nr) + part(ct, nt) - part(p, n))
    return suff.withColumns({"df_detect": varies.cast("int"), "stat_detect": F.when(varies, F.greatest(F.lit(0.0), gain)).otherwise(F.lit(0.0))})


def continuous(suff: DataFrame, min_positive: int) -> DataFrame:
    """stat_continuous, df_continuous, and what moderation needs: beta, s2, dfres, vcoef."""
    cr, ct = F.col("c_ref"), F.col("c_test")
    sr, st, q = F.col("s_ref"), F.col("s_test"), F.col("q_ref") + F.col("q_test")
    n = cr + ct
    square = lambda s, c: F.when(c > 0, s * s / c).otherwise(F.lit(0.0))
    full = F.greatest(F.lit(0.0), q - square(sr, cr) - square(st, ct))
    null = F.greatest(F.lit(0.0), q - square(sr + st, n))
    mean = lambda s, c: F.when(c > 0, s / c).otherwise(F.lit(0.0))
    out = suff.withColumns({"rss_full": F.when(full > NOISE * q, full).otherwise(F.lit(0.0)), "rss_null": null})
    ok = (cr >= 1) & (ct >= 1) & (n >= min_positive) & (n - 2 >= 1) & (F.col("rss_full") > 0)
    stat = n * F.ln(F.greatest(F.col("rss_null") / F.greatest(F.col("rss_full"), F.lit(1e-12)), F.lit(1.0)))
    return out.withColumns({
        "df_continuous": ok.cast("int"), "stat_continuous": F.when(ok, F.greatest(F.lit(0.0), stat)).otherwise(F.lit(0.0)), "beta": F.when(ok, mean(st, ct) - mean(sr, cr)),
        "dfres": F.when(ok, n - 2), "s2": F.when(ok, F.col("rss_full") / (n - 2)), "vcoef": F.when(ok, 1.0 / cr + 1.0 / ct),
    })


def linear_log2fc(mean_test: Column, mean_ref: Column) -> Column:
    """log2 ratio of means on the count scale, a small floor under both."""
    return F.log2((F.expm1(mean_test) + 1e-9) / (F.expm1(mean_ref) + 1e-9))


def reasons(df: DataFrame, min_positive: int, partial: bool) -> DataFrame:
    """skip_reason and tested.  Strict asks for both parts, partial for either."""
    n = F.col("c_ref") + F.col("c_test")
    why = F.when(n == 0, "all_zero")
    if partial:
        why = why.when(F.col("df_detect") + F.col("df_continuous") == 0, "model_failed")
    else:
        why = why.when(n < min_positive, "too_few_positive").when((F.col("c_ref") == 0) | (F.col("c_test") == 0), "no_positive_in_one_group").when(F.col("df_continuous") == 0, "singular_design")
    return df.withColumn("skip_reason", why.otherwise("")).withColumn("tested", F.col("skip_reason") == "")


def combine(df: DataFrame) -> DataFrame:
    """stat_hurdle and df_hurdle, and null for every statistic of what is not tested."""
    parts = {f"{k}_{part}": F.col(f"{k}_{part}") for part in ("detect", "continuous") for k in ("stat", "df")}
    both = {f"{k}_hurdle": F.col(f"{k}_detect") + F.col(f"{k}_continuous") for k in ("stat", "df")}
    return df.withColumns({name: F.when(F.col("tested"), c) for name, c in (parts | both).items()})


def coefficient(df: DataFrame, mode: str) -> DataFrame:
    """coef by mode: difference of means, log2 ratio of linear means, or difference among positives."""
    difference = F.col("mean_expr_test") - F.col("mean_expr_ref")
    value = {"mast_logfc": difference, "mean_difference": difference, "linear_log2fc": linear_log2fc(F.col("mean_expr_test"), F.col("mean_expr_ref")), "continuous": F.col("beta")}
    if mode not in value:
        raise ValueError(f"coef_mode must be one of {sorted(value)}")
    return df.withColumns({"coef": F.when(F.col("tested"), value[mode]), "coef_continuous": F.when(F.col("tested"), F.col("beta"))})


def tails(df: DataFrame) -> DataFrame:
    """p-values and -log10 p of one or two degrees of freedom, by logarithms of tails."""
    log = {k: native.chi2_log_tail(F.col(f"stat_{k}"), F.col(f"df_{k}")) for k in ("hurdle", "detect", "continuous")}
    return df.withColumn("_log", log["hurdle"]).withColumns({
        "pvalue": F.exp("_log"), "neglog10p": native.neglog10(F.col("_log")), "p_detect": F.exp(log["detect"]), "p_continuous": F.exp(log["continuous"]),
    }).drop("_log")


def closed_form(expr: DataFrame, obs: DataFrame, var: DataFrame, sizes: DataFrame, min_positive: int = 10, partial: bool = False) -> DataFrame:
    """All statistics of all cell types in ``sizes`` and all genes; no tails yet."""
    kept = obs.join(F.broadcast(sizes.select("celltype")), "celltype", "left_semi")
    rows = densify(sufficient(expr, kept), sizes, var)
    return combine(reasons(continuous(detection(describe(rows)), min_positive), min_positive, partial))

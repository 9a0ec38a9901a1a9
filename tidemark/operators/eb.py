"""Empirical-Bayes moderation of the residual variances within a cell type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native

LEAST_GENES, MOST_DF = 10, 1e6


def priors(df: DataFrame) -> DataFrame:
    """celltype, d0, s02 by moments over the tested genes with a fitted continuous part; cell types with fewer than ten have none."""
    use = df.where(F.col("tested") & (F.col("df_continuous") == 1) & (F.col("s2") > 0) & (F.col("dfres") > 0) & (F.col("vcoef") > 0))
    half = F.col("dfres") / 2
    e = use.select("celltype", (F.ln("s2") - native.digamma(half) + F.ln(half)).alias("e"), native.trigamma(half).alias("tri"))
    m = e.groupBy("celltype").agg(F.avg("e").alias("mean"), F.var_samp("e").alias("var"), F.avg("tri").alias("tri"), F.count("*").alias("n")).where(F.col("n") >= LEAST_GENES)
    excess = F.col("var") - F.col("tri")
    h = m.withColumn("h", F.when(excess > 0, native.trigamma_inverse(excess)))
    return h.select(
        "celltype", F.least(F.coalesce(2 * F.col("h"), F.lit(MOST_DF)), F.lit(MOST_DF)).alias("d0"),
        F.exp(F.col("mean") + F.coalesce(native.digamma(F.col("h")) - F.ln("h"), F.lit(0.0))).alias("s02"),
    )


def moderate(df: DataFrame) -> DataFrame:
    """Continuous statistics replaced by moderated ones; what depends on them is left to ``tails``."""
    joined = df.join(F.broadcast(priors(df)), "celltype", "left")
    use = F.col("tested") & (F.col("df_continuous") == 1) & F.col("d0").isNotNull() & (F.col("s2") > 0)
    post = (F.col("d0") * F.col("s02") + F.col("dfres") * F.col("s2")) / (F.col("d0") + F.col("dfres"))
    t = F.col("beta") / F.sqrt(F.greatest(post * F.col("vcoef"), F.lit(1e-300)))
    stat = native.chi2_of_log_tail(native.t_log_two_sided(t, F.col("dfres") + F.col("d0")))
    out = joined.withColumn("stat_continuous", F.when(use, stat).otherwise(F.col("stat_continuous")))
    return out.withColumn("stat_hurdle", F.when(F.col("tested"), F.col("stat_detect") + F.col("stat_continuous"))).drop("d0", "s02")

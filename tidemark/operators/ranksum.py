"""Wilcoxon rank sums over sparse values: the zeros of a gene are one block of ties that is never made."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special


@F.pandas_udf(T.DoubleType())
def normal_neglog10(z: pd.Series) -> pd.Series:
    """-log10 of the two-sided normal tail, finite however far out."""
    return pd.Series(-special.log_erfc(z.abs().to_numpy(float) / math.sqrt(2.0)) / special.LN10).where(z.notna())


def two_sided(df: DataFrame) -> DataFrame:
    """neglog10p and pvalue of the column z."""
    return df.withColumn("neglog10p", normal_neglog10("z")).withColumn("pvalue", F.pow(F.lit(10.0), -F.col("neglog10p")))


def rank_sum(expr: DataFrame, obs: DataFrame, sizes: DataFrame) -> DataFrame:
    """celltype, gene, z of the test arm's ranks, normal scale without tie or continuity correction.

    Equal values are one row before anything is sorted, and a gene's values are sorted in bands of a sixteenth of an
    octave; a band's rank sum moves up by the positives in the bands below.  No task holds all values of a gene.
    """
    x = expr.where("value > 0").join(obs.select("cell_id", "celltype", "cond"), "cell_id")
    keys = ["celltype", "gene", "band"]
    x = x.groupBy("celltype", "gene", F.floor(16 * F.log2("value")).alias("band"), "value").agg(F.count("*").alias("n"), F.count_if(F.col("cond") == 1).alias("k"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    x = x.withColumn("r", below + (F.col("n") + 1) / 2.0).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("r")).alias("r"))
    under = F.sum("n").over(Window.partitionBy("celltype", "gene").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    x = x.withColumn("r", F.col("r") + F.col("k") * under)
    g = x.groupBy("celltype", "gene").agg(F.sum("n").alias("nnz"), F.sum("k").alias("nnz_test"), F.sum("r").alias("r_test"))
    j = g.join(sizes.select("celltype", "n_ref", "n_test"), "celltype")
    n, zeros = F.col("n_ref") + F.col("n_test"), F.col("n_ref") + F.col("n_test") - F.col("nnz")
    # a positive's rank stands after all zeros; a zero's is the middle of their block
    r = F.col("r_test") + F.col("nnz_test") * zeros + (F.col("n_test") - F.col("nnz_test")) * (zeros + 1) / 2.0
    spread = F.sqrt(F.col("n_test") * F.col("n_ref") * (n + 1) / 12.0)
    return j.select("celltype", "gene", "n_ref", "n_test", F.try_divide(r - F.col("n_test") * (n + 1) / 2.0, spread).alias("z"))

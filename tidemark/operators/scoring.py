"""Scores against known truth: confusion, ROC, precision; distances of null p-values from uniform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import average_rank


def confusion(df: DataFrame, called: Column, truth: Column, by: list[str]) -> DataFrame:
    c, t = called, truth
    out = df.groupBy(*by).agg(F.count_if(c & t).alias("tp"), F.count_if(c & ~t).alias("fp"), F.count_if(~c & t).alias("fn"), F.count_if(~c & ~t).alias("tn"))
    one = lambda x: F.greatest(x, F.lit(1))
    return out.withColumn("sensitivity", F.col("tp") / one(F.col("tp") + F.col("fn"))).withColumn("observed_fdr", F.col("fp") / one(F.col("tp") + F.col("fp")))


def roc_curve(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Cumulative true and false positives, one row a distinct score from the highest."""
    g = df.groupBy(*by, score).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*by, score, F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))


def roc_auc(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """By rank sums, ties averaged."""
    r = df.withColumn("_r", average_rank(by, F.col(score)))
    a = r.groupBy(*by).agg(F.sum(F.when(F.col(truth), F.col("_r"))).alias("s"), F.count_if(truth).alias("n1"), F.count_if(~F.col(truth)).alias("n0"))
    return a.select(*by, "n1", "n0", F.try_divide(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0")).alias("auc"))


def average_precision(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Sum of recall steps times precision, ties as one step."""
    curve = roc_curve(df, score, truth, by)
    all_ = Window.partitionBy(*by)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    step = F.col("tp") - F.coalesce(F.lag("tp").over(w), F.lit(0))
    part = curve.withColumn("part", F.try_divide(step, F.max("tp").over(all_)) * F.col("tp") / (F.col("tp") + F.col("fp")))
    return part.groupBy(*by).agg(F.sum("part").alias("average_precision"))


def ks_uniform(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of p-values from the uniform distribution."""
    w, every = Window.partitionBy(*by).orderBy(p), Window.partitionBy(*by)
    r = df.where(F.col(p).isNotNull()).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(every))
    return r.groupBy(*by).agg(F.max(F.greatest(F.col("i") / F.col("n") - F.col(p), F.col(p) - (F.col("i") - 1) / F.col("n"))).alias("ks"), F.count("*").alias("n"))


def type_one(df: DataFrame, p: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    return df.where(F.col(p).isNotNull()).groupBy(*by).agg(F.avg((F.col(p) < alpha).cast("double")).alias("rejected"), F.median(p).alias("median_p"), F.count("*").alias("n"))


def fdr_matched(df: DataFrame, score: str, truth: str, rep: str, calibration: list, points: int = 800, level: float = 0.05) -> DataFrame:
    """The least threshold on a quantile grid whose mean observed FDR over the calibration replicates is at most ``level``."""
    cal = df.where(F.col(rep).isin(calibration))
    grid = cal.select(F.explode(F.percentile(score, F.array(*[F.lit(k / (points - 1)) for k in range(points)]))).alias("t")).distinct()
    # reps x points rows; counts of a threshold come from the sorted cumulative curve, not from all pairs of rows
    curve = roc_curve(cal, score, truth, [rep]).select(rep, F.col(score).alias("t"), "tp", "fp")
    reps = cal.select(rep).distinct()
    marks = reps.crossJoin(grid).select(rep, "t", F.lit(None).cast("long").alias("tp"), F.lit(None).cast("long").alias("fp"))
    w = Window.partitionBy(rep).orderBy(F.col("t").desc(), F.col("tp").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = curve.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)))
    filled = filled.withColumn("tp", F.coalesce(F.last("tp", True).over(w), F.lit(0))).withColumn("fp", F.coalesce(F.last("fp", True).over(w), F.lit(0))).where("mark")
    mean = filled.groupBy("t").agg(F.avg(F.col("fp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("fdr"))
    return mean.where(F.col("fdr") <= level).agg(F.min("t").alias("threshold"))


def quartile(column: str, by: list[str], tie: str = "gene") -> Column:
    """Quartile by first-come ranks with linear cut points: bucket = ceil(4 (r - 1) / (n - 1)), 1 at least."""
    w = Window.partitionBy(*by).orderBy(column, tie)
    return F.greatest(F.lit(1), F.ceil(F.try_divide(4 * (F.row_number().over(w) - 1), F.count("*").over(Window.partitionBy(*by)) - 1)).cast("int"))

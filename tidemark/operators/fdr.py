"""Benjamini-Hochberg as a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: list[str], tie: str = "gene", family=None) -> DataFrame:
    """q_i = min over j >= i of p_(j) * m / j within each family; rows without p, or outside ``family``, get null.

    Families never mix with the rest: those rows are a group of their own in the window.
    """
    inside = F.col(p).isNotNull() if family is None else F.col(p).isNotNull() & family
    groups = [*by, inside]
    w = Window.partitionBy(*groups).orderBy(F.col(p), F.col(tie))
    down = Window.partitionBy(*groups).orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ratio = "_ratio_" + out
    q = F.col(p) * F.count("*").over(Window.partitionBy(*groups)) / F.row_number().over(w)
    return df.withColumn(ratio, q).withColumn(out, F.when(inside, F.least(F.lit(1.0), F.min(ratio).over(down)))).drop(ratio)

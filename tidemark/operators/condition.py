"""Which cells are the reference (0) and which the test (1); gates on cell types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_label(label: Column, ref: str, literal: bool = False) -> Column:
    """0 where the label holds ``ref`` in any case (a pattern unless literal), else 1."""
    return F.when(F.coalesce(label.cast("string"), F.lit("")).rlike("(?i)" + (re.escape(ref) if literal else ref)), 0).otherwise(1)


def by_threshold(score: Column, threshold: float) -> Column:
    """1 from the threshold on; what is missing or no number is the reference."""
    x = score.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= threshold), 1).otherwise(0)


def by_exact(obs: DataFrame, column: str, ref: str, test: str) -> DataFrame:
    """Cells with one of two labels; others go."""
    label = F.col(column).cast("string")
    return obs.where(label.isin(ref, test)).withColumn("cond", F.when(label == ref, 0).otherwise(1))


def label_splits(obs: DataFrame, column: str, ref: str) -> None:
    """Raise unless ``ref`` is found in some but not all labels."""
    hit = by_label(F.col(column), ref) == 0
    got = obs.agg(F.count_if(hit).alias("hit"), F.count("*").alias("n")).first()
    if not 0 < got["hit"] < got["n"]:
        raise ValueError(f"{ref!r} must be found in some but not all values of {column!r}: {got['hit']} of {got['n']}")


def group_sizes(obs: DataFrame) -> DataFrame:
    """celltype, n_ref, n_test, n_cells: counted on cells, so that cells without any value count."""
    return obs.groupBy(F.col("celltype").cast("string").alias("celltype")).agg(
        F.count_if(F.col("cond") == 0).alias("n_ref"), F.count_if(F.col("cond") == 1).alias("n_test"), F.count("*").alias("n_cells")
    )


def celltype_gate(sizes: DataFrame, min_cells_per_group: int = 10, min_total_cells: int = 0) -> DataFrame:
    """Adds gate_reason: empty where the cell type may be tested."""
    n, m = F.least("n_ref", "n_test"), min_cells_per_group
    reason = F.when((F.col("n_ref") >= m) & (F.col("n_test") >= m) & (F.col("n_cells") >= min_total_cells), "").when(n == 0, "one_group_missing").otherwise("too_few_cells")
    return sizes.withColumn("gate_reason", reason)


def detection_rate(expr: DataFrame, obs: DataFrame, n_genes: int | Column) -> DataFrame:
    """obs with cdr: the share of all genes that a cell has above zero; cells without values have 0."""
    found = expr.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("detected"))
    n = F.lit(n_genes) if isinstance(n_genes, int) else n_genes
    return obs.join(found, "cell_id", "left").withColumn("cdr", F.coalesce("detected", F.lit(0)) / n).drop("detected")


def maybe_log(expr: DataFrame, assume_logged: bool | None = None) -> DataFrame:
    """Values as logarithms: log1p where the greatest of all is over 100, or as told."""
    if assume_logged is True:
        return expr
    if assume_logged is None and (expr.agg(F.max("value").alias("m")).first()["m"] or 0) <= 100:
        return expr
    return expr.withColumn("value", F.log1p("value"))

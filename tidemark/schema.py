"""Result schema, vocabularies and small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()

#: Names and order of the result's columns.
RESULT = T.StructType([
    T.StructField("primerid", _S), T.StructField("gene", _S), T.StructField("coef", _D), T.StructField("coef_continuous", _D),
    T.StructField("Pr(>Chisq)", _D), T.StructField("pvalue", _D), T.StructField("fdr", _D), T.StructField("neglog10p", _D),
    T.StructField("p_detect", _D), T.StructField("p_continuous", _D),
    T.StructField("stat_detect", _D), T.StructField("stat_continuous", _D), T.StructField("stat_hurdle", _D),
    T.StructField("df_detect", _I), T.StructField("df_continuous", _I), T.StructField("df_hurdle", _I),
    T.StructField("n_cells", _L), T.StructField("n_ref", _L), T.StructField("n_test", _L),
    T.StructField("n_positive", _L), T.StructField("n_positive_ref", _L), T.StructField("n_positive_test", _L),
    T.StructField("detect_rate_ref", _D), T.StructField("detect_rate_test", _D), T.StructField("detection_separated", _B),
    T.StructField("mean_expr_ref", _D), T.StructField("mean_expr_test", _D),
    T.StructField("celltype", _S), T.StructField("comparison", _S), T.StructField("ref_level", _S), T.StructField("test_level", _S), T.StructField("lrt_term", _S),
    T.StructField("tested", _B), T.StructField("skip_reason", _S), T.StructField("method", _S),
])

#: Why a row is not tested.
SKIP_REASONS = (
    "all_zero", "one_group_missing", "too_few_cells", "too_few_positive",
    "no_positive_in_one_group", "singular_design", "logistic_separation", "model_failed",
)
#: Verdicts of the two arms together.
CALLS = ("significant", "ranked_only", "direction_conflict", "ns", "not_tested")
#: The columns that every method's table has after harmonising.
HARMON = (
    "method", "celltype", "comparison", "gene", "pvalue", "fdr", "log2fc", "neglog10p", "stat",
    "n_ref", "n_test", "tested", "skip_reason",
)
METHOD = "two_part_hurdle"


def conform(df: DataFrame, schema: T.StructType = RESULT) -> DataFrame:
    """Columns of the schema in order; those that are missing are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def xlogy(x: Column, y: Column) -> Column:
    """x * ln(y), and 0 where x is 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def average_rank(partition: list[str], order: Column):
    """Average-tie rank within a partition."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition).orderBy(order)
    same = Window.partitionBy(*partition, order)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0

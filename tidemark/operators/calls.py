"""Both arms in one table, and one verdict a gene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_calls(cell: DataFrame, sample: DataFrame, alpha: float = 0.05, require_same_direction: bool = True) -> DataFrame:
    """Full outer join on gene and cell type (clashing names of the sample arm get _pb), with ``call``.

    not_tested where the sample arm didn't test; then significant or direction_conflict below alpha
    at the sample level; then ranked_only below alpha at the cell level; else ns.
    """
    keys = ["gene", "celltype"]
    taken = {c.lower() for c in cell.columns}
    renamed = sample.select(*[F.col(c).alias(c if c in keys or c.lower() not in taken else f"{c}_pb") for c in sample.columns])
    out = cell.join(renamed, keys, "full_outer")
    tested = F.coalesce("pb_tested", F.lit(False)) if "pb_tested" in sample.columns else F.col("pb_padj").isNotNull()
    same = F.lit(True)
    direction = "coef" if "coef" in cell.columns else "coef_continuous" if "coef_continuous" in cell.columns else None
    if require_same_direction and direction:
        same = F.coalesce(F.signum("pb_log2FC") == F.signum(direction), F.lit(False))
    call = (
        F.when(~tested, "not_tested")
        .when(F.coalesce(F.col("pb_padj") < alpha, F.lit(False)), F.when(same, "significant").otherwise("direction_conflict"))
        .when(F.coalesce(F.col("fdr") < alpha, F.lit(False)), "ranked_only")
        .otherwise("ns")
    )
    return out.withColumn("call", call)

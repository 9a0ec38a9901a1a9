"""Sinks: results, diagnostics, MatrixMarket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SKIP_REASONS, conform


def result_path(folder: str, prefix: str, form: str = "parquet", name: str | None = None) -> tuple[str, str]:
    """(result, diagnostics): ``prefix_all_celltypes.<form>`` or the exact name, and ``<stem>_diagnostics.csv``."""
    if form not in ("csv", "parquet"):
        raise ValueError("format must be csv or parquet")
    file = name or f"{prefix}_all_celltypes.{form}"
    return f"{folder}/{file}", f"{folder}/{file.rsplit('.', 1)[0]}_diagnostics.csv"


def write_result(df: DataFrame, path: str, var: DataFrame | None = None) -> str:
    """One distributed write by cell type and gene, genes in the input's order where ``var`` has it (gene, gene_pos); an empty result still has its columns."""
    out = conform(df)
    if var is not None and "gene_pos" in var.columns:
        names, place = out.columns, var.groupBy("gene").agg(F.min("gene_pos").alias("gene_pos"))
        out = out.join(place, "gene", "left").orderBy("celltype", F.col("gene_pos").asc_nulls_last(), "gene").select(names)
    else:
        out = out.orderBy("celltype", "gene")
    if path.endswith(".csv"):
        out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return path


def diagnostics(result: DataFrame, gate: DataFrame) -> DataFrame:
    """One row a cell type: status, counts, and a count for each skip reason."""
    counts = result.groupBy("celltype").agg(F.count("*").alias("n_genes"), F.count_if("tested").alias("n_tested"), *[F.count_if(F.col("skip_reason") == r).alias(f"skip_{r}") for r in SKIP_REASONS])
    ok = F.col("gate_reason") == ""
    return gate.join(counts, "celltype", "left").select(
        "celltype", F.when(ok, "ok").otherwise("skipped_celltype").alias("status"), F.col("gate_reason").alias("skip_reason"), "n_ref", "n_test",
        F.coalesce("n_genes", F.lit(0)).alias("n_genes"), F.when(ok, F.coalesce("n_tested", F.lit(0))).otherwise(F.lit(0)).alias("n_tested"), *[F.coalesce(f"skip_{r}", F.lit(0)).alias(f"skip_{r}") for r in SKIP_REASONS],
    )


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """``column`` and i, its place from 1 in order.  Ranges are cut at quantiles of a hash-drawn thousand of the values, and each is numbered by itself, after those before it."""
    marks = [r[0] for r in df.orderBy(F.xxhash64(column)).limit(1000).collect()]
    marks = sorted(marks)[:: max(1, len(marks) // 200)]
    if not marks:
        return df.withColumn("i", F.lit(0).cast("long"))
    part = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m <= F.col(column)))
    dealt = df.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    # a row a range: at most a few hundred
    starts = sizes.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return dealt.withColumn("_r", within).join(F.broadcast(starts), "_part").select(column, (F.col("_before") + F.col("_r")).alias("i"))


def write_matrix_market(expr: DataFrame, folder: str, value: str = "n") -> None:
    """A genes x cells coordinate file (header, size line, entries by gene and cell) and the two side files, for ``read_matrix_market``
    with the names matrix, genes and cells.  Each is a folder of parts whose names are in order."""
    genes, cells = expr.select("gene").distinct(), expr.select("cell_id").distinct()
    g, c = _numbered(genes, "gene"), _numbered(cells, "cell_id").withColumnRenamed("i", "j")
    entries = expr.join(g, "gene").join(c, "cell_id").select("i", "j", F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.format_string("%.17g", F.col(value).cast("double"))).alias("value"))
    spark, n = expr.sparkSession, entries.count()
    size = f"{genes.count()} {cells.count()} {n}"
    head = spark.createDataFrame([(-1, 0, "%%MatrixMarket matrix coordinate real general"), (0, 0, size)], "i long, j long, value string")
    head.unionByName(entries).orderBy("i", "j").select("value").write.mode("overwrite").text(f"{folder}/matrix")
    g.orderBy("i").select("gene").write.mode("overwrite").text(f"{folder}/genes")
    c.orderBy("j").select(F.col("cell_id").cast("string")).write.mode("overwrite").text(f"{folder}/cells")

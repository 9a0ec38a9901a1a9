"""Methods side by side over one input: each one's table, the genes in a row, pairs of methods, consensus, and a report."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, condition, prep, pseudobulk, ranksum
from ..operators.fdr import benjamini_hochberg
from . import api
from .steps import Clock, timings

#: The methods there are, in the order of the report.
METHODS = ("two_part", "rank_sum", "sample")


def run_method(name: str, expr: DataFrame, counts: DataFrame, obs: DataFrame, var: DataFrame, settings: api.Settings) -> DataFrame:
    """A method's harmonised table.  obs: cell_id, celltype, cond, donor."""
    if name == "two_part":
        return compare.harmonise(api.two_part(expr, obs, var, settings)[0], name)
    if name == "sample":
        return compare.harmonise(pseudobulk.run_pseudobulk(counts, obs, var), name)
    if name != "rank_sum":
        raise ValueError(f"method must be one of {METHODS}, not {name}")
    sizes = condition.group_sizes(obs)
    z = ranksum.rank_sum(expr, obs, sizes).join(_log2fc(expr, obs, sizes), ["celltype", "gene"])
    z = ranksum.two_sided(z).withColumn("tested", F.col("pvalue").isNotNull()).withColumn("stat", F.col("z"))
    return compare.harmonise(benjamini_hochberg(z, "pvalue", "fdr", ["celltype"]), name)


def _log2fc(expr: DataFrame, obs: DataFrame, sizes: DataFrame) -> DataFrame:
    """log2 of the ratio of the arms' means of expm1(mean value), each with 1e-9 added."""
    from ..operators import hurdle

    m = hurdle.describe(hurdle.sufficient(expr, obs).join(sizes, "celltype"))
    return m.select("celltype", "gene", hurdle.linear_log2fc(F.col("mean_expr_test"), F.col("mean_expr_ref")).alias("log2fc"))


def compare_methods(tables: dict[str, DataFrame], k: int = 100, alpha: float = 0.05) -> dict[str, DataFrame]:
    """per_gene (outer-joined values of tested genes), concordance (each two methods), consensus (most methods first) and calls
    (significant genes a cell type and method)."""
    every = None
    for df in tables.values():
        every = df if every is None else every.unionByName(df)
    tested = {m: df.where("tested") for m, df in tables.items()}
    sig = F.count_if(F.coalesce(F.col("fdr") < alpha, F.lit(False)))
    return {
        "per_gene": compare.wide(tested, ["pvalue", "fdr", "log2fc", "neglog10p"]),
        "concordance": compare.pairwise(every, list(tables), k, alpha),
        "consensus": compare.consensus(every.where("tested"), alpha).orderBy(F.desc("n_methods_sig"), "celltype", "gene"),
        "calls": every.where("tested").groupBy("celltype", "method").agg(F.count("*").alias("n_tested"), sig.alias("n_significant")),
    }


def run_comparison(expr: DataFrame, counts: DataFrame, obs: DataFrame, var: DataFrame, folder: str, methods: tuple[str, ...] = METHODS, settings: api.Settings | None = None, k: int = 100, alpha: float = 0.05, celltypes: int = 0, genes: int = 0) -> str:
    """Runs the methods, writes each one's table and the comparison as Parquet under ``folder``; the path of the report.

    ``celltypes`` and ``genes`` above 0 keep the best balanced cell types and the genes of most counts.  Each method runs
    once: the comparison reads what it wrote.
    """
    spark, clock = expr.sparkSession, Clock()
    settings = settings or api.preset(api.Settings())
    if celltypes:
        obs = obs.join(prep.balanced_celltypes(condition.group_sizes(obs), celltypes).select("celltype"), "celltype", "left_semi")
    if genes:
        kept = prep.top_genes(counts, genes).select("gene")
        expr, counts, var = (df.join(kept, "gene", "left_semi") for df in (expr, counts, var))
    tables = {}
    for m in methods:
        with clock.stage(m):
            run_method(m, expr, counts, obs, var, settings).write.mode("overwrite").parquet(f"{folder}/{m}.parquet")
        tables[m] = spark.read.parquet(f"{folder}/{m}.parquet")
    with clock.stage("comparison"):
        found = compare_methods(tables, k, alpha)
        for name, df in found.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    timings(spark.createDataFrame(clock.rows, "process string, stage string, elapsed_s double, cpu_s double, peak_rss_mb double")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/timings.parquet")
    return write_report(spark, folder, methods, alpha)


def write_report(spark: SparkSession, folder: str, methods: tuple[str, ...], alpha: float) -> str:
    """summary.md from the written tables: only rows a cell type and method, or a pair of them, come to the driver."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    every = read("consensus").where(F.col("n_methods_sig") == len(methods)).count()
    text = ["# Comparison of methods", "", f"methods: {', '.join(methods)}", "", f"## Significant genes (fdr < {alpha:g})", "", *_table(read("calls").orderBy("celltype", "method"))]
    text += ["", "## Pairs of methods", "", *_table(read("concordance").orderBy("celltype", "method_a", "method_b"))]
    text += ["", f"Genes significant in all {len(methods)} methods: {every}", "", "## Seconds", "", *_table(read("timings")), ""]
    text += ["Cell-level methods test cells, the sample-level one donors: numbers of calls don't compare, ranks and directions do."]
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary.md")
    return os.path.join(folder, "summary.md")


def _table(df: DataFrame) -> list[str]:
    show = lambda v: f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v)
    rows = ["| " + " | ".join(show(v) for v in r) + " |" for r in df.collect()]
    return ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *rows]

"""Whole runs: the two-part test, the threshold form, the sample-level arm, both together, and a command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, condition, design, eb, general, hurdle, pseudobulk
from ..operators.fdr import benjamini_hochberg
from ..schema import METHOD, conform
from ..sources import readers, writers


@dataclass
class Settings:
    min_cells_per_group: int = 10
    min_total_cells: int = 0
    min_positive: int = 10
    covariates: tuple[str, ...] = ("CDR",)
    partial: bool = False
    moderated: bool = False
    coef_mode: str = "mean_difference"
    fallback: str = "chisq"
    drop_untested: bool = False
    emit_skipped: bool = False
    genes_per_bucket: int = 500
    assume_logged: bool | None = None
    labels: dict[str, str] = field(default_factory=lambda: {"comparison": "ref_vs_test", "ref_level": "ref", "test_level": "test"})


def preset(settings: Settings, moderated: bool | None = None) -> Settings:
    """The two-group preset: no covariates, either part is enough, small gates, moderated unless told otherwise."""
    coef = settings.coef_mode if settings.coef_mode == "linear_log2fc" else "mast_logfc"
    return Settings(1, max(settings.min_total_cells, 20), min(settings.min_positive, 2), (), True, True if moderated is None else moderated, coef, settings.fallback, settings.drop_untested, settings.emit_skipped, settings.genes_per_bucket, settings.assume_logged, settings.labels)


def two_part(expr: DataFrame, obs: DataFrame, var: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(result in the fixed schema, gates a cell type).  obs: cell_id, celltype, cond, covariates; expr: cell_id, gene, value; var: gene.

    Without covariates that vary, everything is closed form; else genes are fitted in buckets.
    """
    obs = obs.withColumn("celltype", F.col("celltype").cast("string"))
    expr = condition.maybe_log(expr, settings.assume_logged)
    gate = condition.celltype_gate(condition.group_sizes(obs), settings.min_cells_per_group, settings.min_total_cells)
    sizes = gate.where("gate_reason = ''").drop("gate_reason")
    names: list[str] = []
    kept = obs.join(F.broadcast(sizes.select("celltype")), "celltype", "left_semi")
    if settings.covariates:
        cells = kept
        if any(c.lower() == "cdr" for c in settings.covariates):
            cells = condition.detection_rate(expr, kept, var.count())
        cells, names = design.design(cells, list(settings.covariates))
        varying = cells.agg(*[F.count(n).alias(n) for n in names]).first() if names else None
        names = [n for n in names if varying[n]]
    if names:
        fits = general.fit_all(expr, cells, names, settings.min_positive, settings.partial, settings.fallback, settings.genes_per_bucket)
        rows = sizes.crossJoin(var.select("gene")).join(fits, ["celltype", "gene"], "left").fillna(0, ["c_ref", "c_test", "df_detect", "df_continuous"]).fillna(0.0, ["s_ref", "s_test", "stat_detect", "stat_continuous"])
        rows = rows.withColumn("skip_reason", F.coalesce("skip", F.lit("all_zero"))).withColumn("tested", F.col("skip_reason") == "")
        rows = hurdle.combine(hurdle.describe(rows))
    else:
        rows = hurdle.closed_form(expr, kept, var, sizes, settings.min_positive, settings.partial)
    if settings.moderated:
        rows = eb.moderate(rows)
    rows = hurdle.tails(hurdle.coefficient(rows, settings.coef_mode))
    rows = benjamini_hochberg(rows, "pvalue", "fdr", ["celltype"])
    if settings.drop_untested:
        rows = rows.where("tested")
    rows = rows.select("*", F.col("gene").alias("primerid"), F.col("pvalue").alias("Pr(>Chisq)"), F.col("c_ref").alias("n_positive_ref"), F.col("c_test").alias("n_positive_test"))
    names_ = {c: F.lit(settings.labels[c]) for c in ("comparison", "ref_level", "test_level")} | {"lrt_term": F.lit("condition" + settings.labels["test_level"])}
    out = conform(rows.withColumns({"method": F.lit(METHOD)} | names_))
    if settings.emit_skipped and not settings.drop_untested:
        skipped = gate.where("gate_reason <> ''").crossJoin(var.select("gene")).select("celltype", "gene", F.col("gene").alias("primerid"), "n_cells", "n_ref", "n_test", F.lit(False).alias("tested"), F.lit(False).alias("detection_separated"), F.col("gate_reason").alias("skip_reason"), F.lit(METHOD).alias("method"), *[c.alias(k) for k, c in names_.items()])
        out = out.unionByName(conform(skipped))
    return out, gate


def run_two_part(expr: DataFrame, obs: DataFrame, var: DataFrame, ref: str, test: str, column: str = "condition", folder: str | None = None, prefix: str = "two_part", form: str = "parquet", name: str | None = None, mast_compat: bool = False, settings: Settings = Settings()) -> DataFrame | str:
    """Condition by label, the test, and (with a folder) the result and its diagnostics written."""
    settings = preset(settings) if mast_compat else settings
    settings = replace(settings, labels={"comparison": f"{ref}_vs_{test}", "ref_level": ref, "test_level": test})
    result, gate = two_part(expr, obs.withColumn("cond", condition.by_label(F.col(column), ref)), var, settings)
    return _written(result, gate, var, folder, prefix, form, name)


def run_threshold(expr: DataFrame, obs: DataFrame, var: DataFrame, score: str, threshold: float, ref: str = "low", test: str = "high", folder: str | None = None, prefix: str = "threshold", form: str = "parquet", name: str | None = None, settings: Settings = Settings()) -> DataFrame | str:
    """The same with the condition from a numeric score."""
    settings = replace(settings, labels={"comparison": f"{test}_vs_{ref}_thr{threshold}", "ref_level": ref, "test_level": test})
    result, gate = two_part(expr, obs.withColumn("cond", condition.by_threshold(F.col(score), threshold)), var, settings)
    return _written(result, gate, var, folder, prefix, form, name)


def _written(result: DataFrame, gate: DataFrame, var: DataFrame, folder: str | None, prefix: str, form: str, name: str | None) -> DataFrame | str:
    if folder is None:
        return result
    path, diag = writers.result_path(folder, prefix, form, name)
    writers.write_result(result, path, var)
    # counts come from what was written: nothing is computed twice
    written = readers.read_result(result.sparkSession, path)
    writers.diagnostics(written, gate).orderBy("celltype").coalesce(1).write.mode("overwrite").option("header", True).csv(diag)
    return path


def run_both_arms(expr: DataFrame, counts: DataFrame, obs: DataFrame, var: DataFrame, ref: str, test: str, donor: str = "donor", column: str = "condition", alpha: float = 0.05, paired: bool = False, use_t: bool = False, min_cells_per_donor: int = 10, min_donors_per_group: int = 2, min_gene_counts: int = 10, settings: Settings = Settings()) -> DataFrame:
    """Cell-level and sample-level results joined, with a verdict a gene."""
    missing = [c for c in (donor, column) if c not in obs.columns]
    if missing:
        raise ValueError(f"obs lacks {missing}")
    if donor == column:
        raise ValueError("donor and condition must be different columns")
    cell = run_two_part(expr, obs, var, ref, test, column, settings=settings)
    sample_obs = condition.by_exact(obs, column, ref, test).withColumn("donor", F.col(donor))
    sample = pseudobulk.run_pseudobulk(counts, sample_obs, var, min_cells_per_donor, min_donors_per_group, min_gene_counts, paired, use_t)
    return calls.combine_calls(cell, sample, alpha)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemark", description="Two-part differential test on long Parquet tables.")
    p.add_argument("mode", choices=("reference", "threshold", "compare"))
    for name in ("--obs", "--expr", "--var", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--column", default="condition")
    p.add_argument("--ref", default="ref")
    p.add_argument("--test", default="test")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--prefix", default="two_part")
    p.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    p.add_argument("--preset", action="store_true")
    p.add_argument("--covariates", nargs="*", default=["CDR"])
    p.add_argument("--counts", help="compare: the table of counts (cell_id, gene, n); --expr where it isn't given")
    p.add_argument("--donor", default="donor")
    p.add_argument("--methods", nargs="*", help="compare: the methods, all where none is named")
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--top", type=int, default=100)
    p.add_argument("--celltypes", type=int, default=0)
    p.add_argument("--genes", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    obs, expr, var = (spark.read.parquet(x) for x in (a.obs, a.expr, a.var))
    settings = Settings(covariates=tuple(a.covariates))
    if a.mode == "reference":
        condition.label_splits(obs, a.column, a.ref)
        print(run_two_part(expr, obs, var, a.ref, a.test, a.column, a.out, a.prefix, a.format, mast_compat=a.preset, settings=settings))
    elif a.mode == "compare":
        from . import comparison

        cells = condition.by_exact(obs, a.column, a.ref, a.test).withColumn("donor", F.col(a.donor))
        counts = spark.read.parquet(a.counts) if a.counts else expr
        used = preset(settings) if a.preset else settings
        print(comparison.run_comparison(expr, counts, cells, var, a.out, tuple(a.methods or comparison.METHODS), used, a.top, a.alpha, a.celltypes, a.genes))
    else:
        print(run_threshold(expr, obs, var, a.column, a.threshold, a.ref, a.test, a.out, a.prefix, a.format, settings=preset(settings) if a.preset else settings))


if __name__ == "__main__":
    main()

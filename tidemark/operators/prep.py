"""Preparation: normalising and recovering counts, merging runs, majority labels, overlaps, contracts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import keep

SCALE = 1e4
#: Rows of a part whose keys a task holds at once, on average.
ROWS = 500_000


def cp10k(counts: DataFrame) -> DataFrame:
    """value = log1p(n * 1e4 / the cell's total)."""
    total = F.sum("n").over(Window.partitionBy("cell_id"))
    return counts.withColumn("total", total).withColumn("value", F.log1p(F.col("n") * SCALE / F.col("total")))


def recover_counts(normal: DataFrame) -> DataFrame:
    """Counts back from normalised values and totals, with the worst rounding error."""
    x = F.expm1("value") * F.col("total") / SCALE
    return normal.withColumn("recovered", F.rint(x).cast("long")).withColumn("error", F.abs(x - F.rint(x)))


def merge_runs(counts: DataFrame, key: list[str]) -> DataFrame:
    """Counts of the same key and gene over all runs."""
    return counts.groupBy(*key, "gene").agg(F.sum("n").alias("n"))


def majority_label(df: DataFrame, key: list[str], label: str, weight: str) -> DataFrame:
    """The commonest label of each key, ties to the label with the heaviest copy, then by name; its share; all labels."""
    g = df.groupBy(*key, label).agg(F.count("*").alias("n"), F.max(weight).alias("heaviest"))
    w, every = Window.partitionBy(*key).orderBy(F.desc("n"), F.desc("heaviest"), label), Window.partitionBy(*key)
    labels = F.array_join(F.array_sort(F.collect_set(label).over(every)), ",")
    out = g.withColumn("r", F.row_number().over(w)).withColumn("agreement", F.col("n") / F.sum("n").over(every)).withColumn("labels", labels)
    return out.where("r = 1").select(*key, F.col(label).alias("label"), "agreement", "labels")


def run_overlap(cells: DataFrame) -> DataFrame:
    """Pairs of runs of a donor that share barcodes: an equi-join on donor and barcode, run order by name."""
    a, b = cells.alias("a"), cells.alias("b")
    j = a.join(b, (F.col("a.donor") == F.col("b.donor")) & (F.col("a.barcode") == F.col("b.barcode")) & (F.col("a.run") < F.col("b.run")))
    return j.groupBy(F.col("a.donor").alias("donor"), F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b")).agg(F.count("*").alias("shared"))


def shared_molecules(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of two count tables by (barcode, gene): shared sum S, both totals, shares, repeated fraction."""
    j = a.select("barcode", "gene", F.col("n").alias("x")).join(b.select("barcode", "gene", F.col("n").alias("y")), ["barcode", "gene"], "full_outer").fillna(0, ["x", "y"])
    g = j.agg(F.sum(F.least("x", "y")).alias("shared"), F.sum("x").alias("total_a"), F.sum("y").alias("total_b"))
    return g.withColumn("p_a", F.try_divide("shared", "total_a")).withColumn("p_b", F.try_divide("shared", "total_b")).withColumn("repeated", F.try_divide(2 * F.col("shared"), F.col("total_a") + F.col("total_b")))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().fillna(0)


def gene_gate(suff: DataFrame, share: float = 0.10) -> DataFrame:
    """Genes detected in both arms and in at least ``share`` of the cells of one."""
    return suff.where((F.col("c_ref") > 0) & (F.col("c_test") > 0) & (F.greatest(F.col("c_ref") / F.col("n_ref"), F.col("c_test") / F.col("n_test")) >= share))


def expressed_in(expr: DataFrame, k: int) -> DataFrame:
    """Values of genes with at least k cells above zero."""
    keep = expr.where("value > 0").groupBy("gene").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("gene")
    return expr.join(keep, "gene", "left_semi")


def top_genes(expr: DataFrame, n: int, value: str = "n") -> DataFrame:
    """The n genes of greatest total, ties by name."""
    return expr.groupBy("gene").agg(F.sum(value).alias("total")).orderBy(F.desc("total"), "gene").limit(n)


def balanced_celltypes(sizes: DataFrame, n: int, least: int = 10) -> DataFrame:
    """The n cell types with the largest smaller arm."""
    return sizes.withColumn("balance", F.least("n_ref", "n_test")).where(F.col("balance") >= least).orderBy(F.desc("balance"), "celltype").limit(n)


def members(var: DataFrame, listed: DataFrame, symbol: str = "gene", versioned: str | None = None) -> DataFrame:
    """Genes on a list by symbol in any case, or by id without its version: two semi-joins, no OR join."""
    one = var.join(listed.select(F.upper("gene").alias("_k")).distinct(), F.upper(symbol) == F.col("_k"), "left_semi")
    if versioned is None:
        return one
    two = var.join(listed.select(F.col("gene").alias("_k")).distinct(), F.split(versioned, "\\.")[0] == F.col("_k"), "left_semi")
    return one.union(two).distinct()


def without_top_genes(expr: DataFrame, n: int = 50, value: str = "n") -> DataFrame:
    """Values of all genes but the n of greatest total (ties by name) and those without any."""
    keep = expr.groupBy("gene").agg(F.sum(value).alias("total")).where(F.col("total") > 0).select("gene")
    keep = keep.join(top_genes(expr, n, value).select("gene"), "gene", "left_anti")
    return expr.join(keep, "gene", "left_semi")


def keep_top_genes(var: DataFrame, expr: DataFrame, n: int, value: str = "n") -> DataFrame:
    """The genes of ``var`` (gene, gene_pos) among the n of greatest total, in the order they had."""
    return var.join(top_genes(expr, n, value).select("gene"), "gene", "left_semi").orderBy("gene_pos")


def cells_with_counts(expr: DataFrame, value: str = "n") -> DataFrame:
    """Values of cells whose total is above zero."""
    keep = expr.groupBy("cell_id").agg(F.sum(value).alias("total")).where(F.col("total") > 0).select("cell_id")
    return expr.join(keep, "cell_id", "left_semi")


def looked_up(df: DataFrame, key: str, names: DataFrame, out: str, fallback: Column) -> DataFrame:
    """``out``: the name that the table (``key``, name) has for the row's key, else ``fallback``.  Of several names of a key
    the least counts; a null key has the fallback."""
    one = names.groupBy(F.col(key).alias("_key")).agg(F.min("name").alias("_name"))
    return df.join(one, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_name", fallback)).drop("_key", "_name")


def with_counts(samples: DataFrame, cells: DataFrame, key: str = "donor", out: str = "cells") -> DataFrame:
    """The sample table with the number of cells of each key; null where a key has none."""
    return samples.join(cells.groupBy(key).agg(F.count("*").alias(out)), key, "left")


def first_and_all(df: DataFrame, by: list[str], value: str, place: str) -> DataFrame:
    """Per group: the value of the row that comes first by ``place`` (null values are passed over), and all values, sorted, without repeats."""
    have = F.col(value).isNotNull()
    return df.groupBy(*by).agg(F.min_by(value, F.when(have, F.struct(place, value))).alias("first"), F.array_join(F.array_sort(F.collect_set(value)), ",").alias("every"))


def barcode(name: Column) -> Column:
    return F.regexp_extract(name, "([ACGT]{14,16})", 1)


def library(name: Column) -> Column:
    """A library's donor, batch (null where it has none) and run, from names such as HPAP-012_FGC34_5 or HPAP012_5."""
    part = lambda k: F.nullif(F.regexp_extract(name, "HPAP-?(\\d{3})_(?:(FGC\\d+)_)?(\\d+)$", k), F.lit(""))
    return F.struct(part(1).alias("donor"), part(2).alias("batch"), part(3).alias("run"))


def check_contract(obs: DataFrame, counts: DataFrame, unpaired: bool = False) -> DataFrame:
    """(rule, violations): unique cells, known conditions, counts whole, finite and not negative, known cells, donors in one condition.

    Both tables are written once, for all rules; rules on cells and pairs go over parts of at most some ROWS rows, by cell.
    """
    obs = keep(obs.select("cell_id", "cond", *["donor"] * unpaired), "obs")
    counts = keep(counts.select("cell_id", "gene", "n"), "counts")
    parts = max(1, math.ceil(max(obs.count(), counts.count()) / ROWS))
    cells, pairs = (df.select(*c).repartition(parts, "cell_id") for df, c in ((obs, ["cell_id"]), (counts, ["cell_id", "gene"])))
    rules = [
        cells.groupBy("cell_id").count().where("count > 1").agg(F.lit("cell_id_unique").alias("rule"), F.count("*").alias("violations")),
        obs.where("cond IS NULL OR cond NOT IN (0, 1)").agg(F.lit("condition_known").alias("rule"), F.count("*").alias("violations")),
        counts.where((F.col("n") < 0) | F.isnan(F.col("n").cast("double")) | (F.col("n") != F.rint("n"))).agg(F.lit("counts_whole").alias("rule"), F.count("*").alias("violations")),
        pairs.groupBy("cell_id", "gene").count().where("count > 1").agg(F.lit("pairs_unique").alias("rule"), F.count("*").alias("violations")),
        pairs.join(cells, "cell_id", "left_anti").agg(F.lit("cells_known").alias("rule"), F.count("*").alias("violations")),
    ]
    if unpaired:
        rules.append(obs.groupBy("donor").agg(F.count_distinct("cond").alias("k")).where("k > 1").agg(F.lit("donor_in_one_condition").alias("rule"), F.count("*").alias("violations")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def check_values(normal: DataFrame, totals: DataFrame | None = None, tolerance: float = 1e-5) -> DataFrame:
    """(rule, violations) of stored values beside their counts (cell_id, gene, n, value): cells without a count, stored zeros,
    values further than ``tolerance`` from log1p(n * 1e4 / the cell's total), and, with ``totals`` (cell_id, total, nnz), cells
    whose sum or number of counts is another."""
    x = normal.withColumn("_t", F.sum("n").over(Window.partitionBy("cell_id")))
    far = F.abs(F.col("value") - F.log1p(F.col("n") * SCALE / F.col("_t"))) > tolerance
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    one = x.agg(bad(F.col("n") == 0).alias("no_stored_zeros"), bad(far).alias("values_of_counts"))
    out = one.select(F.explode(F.create_map(F.lit("no_stored_zeros"), "no_stored_zeros", F.lit("values_of_counts"), "values_of_counts")).alias("rule", "violations"))
    cells = normal.groupBy("cell_id").agg(F.sum("n").alias("_sum"), F.count_if(F.col("n") != 0).alias("_nnz"))
    out = out.unionByName(cells.where("_sum <= 0").agg(F.lit("cells_with_counts").alias("rule"), F.count("*").alias("violations")))
    if totals is not None:
        j = cells.join(totals.select("cell_id", "total", "nnz"), "cell_id", "full_outer")
        for rule, a, b in (("cell_sums", "_sum", "total"), ("cell_nnz", "_nnz", "nnz")):
            out = out.unionByName(j.where(~F.coalesce(F.col(a).cast("double"), F.lit(0.0)).eqNullSafe(F.coalesce(F.col(b).cast("double"), F.lit(0.0)))).agg(F.lit(rule).alias("rule"), F.count("*").alias("violations")))
    return out


def size_normalised(expr: DataFrame) -> DataFrame:
    """n over the cell's size factor: its total by the median of all totals."""
    total = expr.groupBy("cell_id").agg(F.sum("n").alias("total"))
    return expr.join(total.crossJoin(total.agg(F.percentile("total", 0.5).alias("middle"))), "cell_id").withColumn("normal", F.col("n") * F.col("middle") / F.col("total"))


def donor_spread(expr: DataFrame, obs: DataFrame, least: float = 0.2) -> DataFrame:
    """(sigma_d, n_genes): the standard deviation between donors of log mean size-normalised counts, by the median over genes
    with a mean above ``least`` that every donor has: their variance over donors less its part from sampling cells,
    the mean over donors of (1 / mean + dispersion) / cells, and not below 0."""
    sizes = obs.groupBy("donor").agg(F.count("*").alias("cells"))
    whole = sizes.agg(F.count("*").alias("donors"), F.sum("cells").alias("all"), F.avg(1.0 / F.col("cells")).alias("inverse"))
    x = size_normalised(expr).join(obs.select("cell_id", "donor"), "cell_id").groupBy("gene", "donor").agg(F.sum("normal").alias("s"), F.sum(F.col("normal") * F.col("normal")).alias("q"))
    logs = F.when(F.col("s") > 0, F.log(F.col("s") / F.col("cells")))
    g = x.join(sizes, "donor").groupBy("gene").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(logs).alias("have"), F.var_samp(logs).alias("v")).crossJoin(whole)
    mu = F.col("s") / F.col("all")
    g = g.withColumn("mu", mu).withColumn("phi", F.least(F.lit(20.0), F.greatest(F.lit(1e-3), (F.col("q") / F.col("all") - mu * mu - mu) / (mu * mu))))
    g = g.where((F.col("have") == F.col("donors")) & (F.col("mu") > least)).withColumn("between", F.greatest(F.lit(0.0), F.col("v") - (1.0 / F.col("mu") + F.col("phi")) * F.col("inverse")))
    return g.agg(F.sqrt(F.percentile("between", 0.5)).alias("sigma_d"), F.count("*").alias("n_genes"))


def nb_moments(pb: DataFrame) -> DataFrame:
    """Per cell type and gene: mean and moment dispersion of counts over samples, clipped to [1e-3, 20]."""
    g = pb.groupBy("celltype", "gene").agg(F.avg("n").alias("mean"), F.var_samp("n").alias("var"))
    disp = F.try_divide(F.col("var") - F.col("mean"), F.col("mean") * F.col("mean"))
    return g.withColumn("dispersion", F.least(F.lit(20.0), F.greatest(F.lit(1e-3), F.coalesce(disp, F.lit(1e-3)))))

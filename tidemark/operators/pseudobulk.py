"""The sample-level arm: counts summed a donor and condition, gates, and the negative-binomial test.

The test deals genes out: a gene and its samples are one row, fitted in Arrow batches.  Size factors,
the dispersion trend, the prior's width and the cut of independent filtering are aggregates over genes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import smooth, special
from . import nb
from .dealing import deal
from .fdr import benjamini_hochberg

RESULT = (
    "celltype string, gene string, pb_log2FC double, pb_pvalue double, pb_padj double, pb_stat double, pb_neglog10p double"
)


def samples(obs: DataFrame, min_cells_per_donor: int = 10) -> DataFrame:
    """celltype, donor, cond, n_cells, sample.  A donor found in one condition only names its sample; else the condition is added."""
    n = obs.groupBy("celltype", "donor", "cond").agg(F.count("*").alias("n_cells"))
    alone = F.count("*").over(Window.partitionBy("celltype", "donor")) == 1
    donor = F.col("donor").cast("string")
    named = n.withColumn("sample", F.when(alone, donor).otherwise(F.concat_ws("|", donor, F.when(F.col("cond") == 0, "ref").otherwise("test"))))
    return named.where(F.col("n_cells") >= min_cells_per_donor)


def sums(counts: DataFrame, obs: DataFrame, meta: DataFrame, dense_over: DataFrame | None = None) -> DataFrame:
    """celltype, sample, donor, cond, gene, n: whole counts (half to even); with ``dense_over`` (genes) absent ones are 0."""
    keys = ["celltype", "donor", "cond"]
    x = counts.join(obs.select("cell_id", *keys), "cell_id").groupBy(*keys, "gene").agg(F.rint(F.sum("n")).cast("long").alias("n"))
    named = meta.select(*keys, "sample")
    if dense_over is None:
        return x.join(named, keys).select("celltype", "sample", "donor", "cond", "gene", "n")
    every = named.crossJoin(dense_over.select("gene"))
    return every.join(x, [*keys, "gene"], "left").fillna(0, ["n"]).select("celltype", "sample", "donor", "cond", "gene", "n")


def donor_gate(meta: DataFrame, min_donors_per_group: int = 2) -> DataFrame:
    """celltype, n_donors_ref, n_donors_test, reason (empty where there are enough; its words are fixed values)."""
    n = meta.groupBy("celltype").agg(F.count_if(F.col("cond") == 0).alias("n_donors_ref"), F.count_if(F.col("cond") == 1).alias("n_donors_test"))
    return n.withColumn("reason", F.when(F.least("n_donors_ref", "n_donors_test") >= min_donors_per_group, "").otherwise(F.format_string(f"need>={min_donors_per_group} donors/group (ref=%d, test=%d)", "n_donors_ref", "n_donors_test")))


def gene_filter(pb: DataFrame, min_gene_counts: int = 10) -> DataFrame:
    """Rows of genes with enough counts over a cell type's samples."""
    keep = pb.groupBy("celltype", "gene").agg(F.sum("n").alias("total")).where(F.col("total") >= min_gene_counts)
    return pb.join(keep.select("celltype", "gene"), ["celltype", "gene"], "left_semi")


def design_choice(meta: DataFrame) -> DataFrame:
    """celltype, design: paired where every donor has both conditions (two donors at least), unpaired where none has, else mixed."""
    d = meta.groupBy("celltype", "donor").agg(F.count_distinct("cond").alias("k"))
    return d.groupBy("celltype").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).select(
        "celltype", F.when((F.col("low") == 2) & (F.col("n") > 1), "paired").when(F.col("high") == 1, "unpaired").otherwise("mixed").alias("design")
    )


#: Genes times samples in a working array of a fit, with the points of its dispersion grid.
CELLS = 2_000_000
TREND_ROUNDS, TREND_DONE = 30, 1e-6
#: Cuts that independent filtering tries, the greatest share of genes that one leaves out, and the share of cuts in a local line.
CUTS, HIGHEST, NEAR = 50, 0.95, 1 / 5


def size_factors(pb: DataFrame) -> DataFrame:
    """celltype, sample, size: the median over genes of the ratio to the geometric mean of the samples.

    Genes that some sample lacks take no part; where no gene is left, a sample's positive counts do, and factors are centred.
    """
    log = F.ln(F.when(F.col("n") > 0, F.col("n").cast("double")))
    gene = pb.groupBy("celltype", "gene").agg((F.sum(log) / F.count("*")).alias("mean"), (F.min("n") > 0).alias("whole"))
    some = gene.groupBy("celltype").agg(F.max("whole").alias("any_whole"))
    use = gene.join(F.broadcast(some), "celltype").where(F.col("mean").isNotNull() & (F.col("whole") | ~F.col("any_whole")))
    ratios = pb.where("n > 0").join(use, ["celltype", "gene"]).groupBy("celltype", "sample").agg(F.percentile(log - F.col("mean"), 0.5).alias("ratio"), F.first("any_whole").alias("any_whole"))
    centre = F.avg("ratio").over(Window.partitionBy("celltype"))
    return ratios.select("celltype", "sample", F.exp(F.col("ratio") - F.when(F.col("any_whole"), 0.0).otherwise(centre)).alias("size"))


def _by_type(b: pa.RecordBatch):
    """(rows, donors, cond, size, counts as samples x genes) of the genes of a cell type in a batch, a part of the genes at a time."""
    types = np.array(b.column("celltype").to_pylist(), dtype=object)
    for t in sorted(set(types)):
        rows = np.flatnonzero(types == t)
        samples = b.column("samples").take(pa.array(rows))
        k = len(samples[0])
        flat = samples.flatten()
        fields = {f: flat.field(f).to_numpy(zero_copy_only=False).reshape(len(rows), k) for f in ("donor", "cond", "size", "n")}
        step = max(1, CELLS // (25 * k))
        for i in range(0, len(rows), step):
            yield rows[i : i + step], list(fields["donor"][0]), fields["cond"][0].astype(int), fields["size"][0].astype(float), fields["n"][i : i + step].T.astype(float)


def _batches(rows: DataFrame, fit, names: list[str]) -> DataFrame:
    """celltype, gene and ``names`` (doubles) that ``fit`` gives for genes of a cell type; null where it gives none."""

    def run(batches):
        for b in batches:
            out = {c: np.full(b.num_rows, np.nan) for c in names}
            for at, donors, cond, size, y in _by_type(b):
                with np.errstate(all="ignore"):
                    found = fit(b, at, donors, cond, size, y)
                for c in names if found else ():
                    out[c][at] = found[c]
            yield pa.RecordBatch.from_arrays([b.column("celltype"), b.column("gene"), *[pa.array(out[c], from_pandas=True) for c in names]], ["celltype", "gene", *names])

    return rows.mapInArrow(run, "celltype string, gene string, " + ", ".join(f"{c} double" for c in names))


def gene_rows(pb: DataFrame) -> DataFrame:
    """celltype, gene, samples (an array of donor, cond, size, n); samples that got no size factor are left out."""
    sized = pb.join(size_factors(pb), ["celltype", "sample"])
    return sized.groupBy("celltype", "gene").agg(F.array_sort(F.collect_list(F.struct(F.col("donor").cast("string").alias("donor"), "cond", "size", "n"))).alias("samples"))


def trends(fits: DataFrame) -> DataFrame:
    """celltype, a0, a1 of the dispersion a0 + a1 / mean: gamma regression of the genes not far off, a step an aggregate; flat where that doesn't settle.

    ``fits``: celltype, mean, disp.  Sums are collected: six numbers a cell type.
    """
    use = fits.where((F.col("disp") > 100 * nb.LEAST_DISP) & (F.col("mean") > 0))
    flat = {r["celltype"]: max(r["flat"], nb.LEAST_DISP) for r in use.groupBy("celltype").agg(F.avg("disp").alias("flat")).collect()}
    known, done = dict.fromkeys(flat, (0.1, 1.0)), set()
    spark = fits.sparkSession
    for _ in range(TREND_ROUNDS):
        live = [(t, *known[t]) for t in flat if t not in done and known[t] is not None]
        if not live:
            break
        fitted = F.col("a0") + F.col("a1") / F.col("mean")
        ratio, u, w = F.col("disp") / fitted, 1 / F.col("mean"), 1 / (fitted * fitted)
        near = use.join(F.broadcast(spark.createDataFrame(live, "celltype string, a0 double, a1 double")), "celltype").where((ratio > 1e-4) & (ratio < 15))
        sums = near.groupBy("celltype").agg(F.count("*").alias("n"), *[F.sum(w * c).alias(k) for k, c in (("w", F.lit(1.0)), ("u", u), ("uu", u * u), ("d", F.col("disp")), ("ud", u * F.col("disp")))])
        found = {r["celltype"]: r for r in sums.collect()}
        for t, a0, a1 in live:
            r = found.get(t)
            det = r["w"] * r["uu"] - r["u"] ** 2 if r and r["n"] >= 3 else 0.0
            if not det > 1e-12 * r["w"] * r["uu"] if r else True:
                known[t] = None
                continue
            new = (max((r["d"] * r["uu"] - r["ud"] * r["u"]) / det, 1e-12), max((r["w"] * r["ud"] - r["u"] * r["d"]) / det, 1e-12))
            if math.log(new[0] / a0) ** 2 + math.log(new[1] / a1) ** 2 < TREND_DONE:
                done.add(t)
            known[t] = new
    rows = [(t, *(known[t] if t in done else (flat[t], 0.0))) for t in flat]
    return spark.createDataFrame(rows, "celltype string, a0 double, a1 double")


def priors(fits: DataFrame, trend: DataFrame) -> DataFrame:
    """celltype, a0, a1, spread, width: a robust deviation of log dispersions from the trend, and its square less what the fits' own noise gives (``fits`` has df)."""
    excess = fits.join(F.broadcast(trend), "celltype").withColumn("e", F.ln("disp") - F.ln(F.col("a0") + F.col("a1") / F.greatest("mean", F.lit(1e-8))))
    far = excess.where(F.col("disp") >= 100 * nb.LEAST_DISP)
    middle = far.groupBy("celltype").agg(F.percentile("e", 0.5).alias("middle"))
    spread = far.join(F.broadcast(middle), "celltype").groupBy("celltype").agg((F.percentile(F.abs(F.col("e") - F.col("middle")), 0.5) * 1.4826).alias("spread"))
    df = fits.groupBy("celltype").agg(F.max("df").alias("df"))
    known = trend.join(spread, "celltype", "left").join(df, "celltype").collect()
    rows = [(r["celltype"], r["a0"], r["a1"], r["spread"] or 0.0, max((r["spread"] or 0.0) ** 2 - float(special.trigamma([r["df"] / 2])[0]), 0.25)) for r in known]
    return fits.sparkSession.createDataFrame(rows, "celltype string, a0 double, a1 double, spread double, width double")


def test(pb: DataFrame, paired: bool = False, use_t: bool = False, alpha: float = 0.1) -> DataFrame:
    """Negative-binomial Wald test of a dense table of ``sums``: RESULT, a row a gene."""
    donors_of = lambda donors: donors if paired else None
    rows = deal(gene_rows(pb), "celltype", "gene").persist()

    def first(_, at, donors, cond, size, y):
        x = nb.design(cond, donors_of(donors))
        some = y.sum(0) > 0
        if not nb.estimable(x) or not some.any():
            return None
        out = {c: np.full(len(at), np.nan) for c in ("mean", "disp", "df")}
        out["mean"][some], out["disp"][some] = nb.gene_wise(y[:, some], x, size)
        out["df"][some] = len(y) - x.shape[1]
        return out

    fits = _batches(rows, first, ["mean", "disp", "df"]).persist()
    usable = fits.where("disp IS NOT NULL")
    known = priors(usable, trends(usable))

    def last(b, at, donors, cond, size, y):
        params = {c: b.column(c)[int(at[0])].as_py() for c in ("a0", "a1", "spread", "width")}
        disp = b.column("disp").to_numpy(zero_copy_only=False)[at]
        ok = np.isfinite(disp)
        if params["a0"] is None or not ok.any():
            return None
        trend = lambda m: params["a0"] + params["a1"] / np.maximum(m, 1e-8)
        found = nb.wald(y[:, ok], cond, donors_of(donors), size, disp[ok], trend, params["width"], params["spread"], use_t)
        out = {}
        for c, v in found.items():
            out[c] = np.full(len(at), np.nan)
            out[c][ok] = v
        return out

    both = rows.join(fits, ["celltype", "gene"]).join(F.broadcast(known), "celltype", "left")
    names = ["mean", "pb_log2FC", "pb_pvalue", "pb_stat", "pb_neglog10p"]
    both = deal(both.select("celltype", "gene", "samples", "disp", "a0", "a1", "spread", "width"), "celltype", "gene")
    found = filtered(_batches(both, last, names).persist(), alpha)
    return found.select(*[c.split()[0] for c in RESULT.split(", ")]).persist()


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first of a cell type's cuts whose rejections come within the noise of the best of their local lines; the lowest where there are few."""
    pdf = pdf.sort_values("j")
    rejected, j = pdf["rejected"].to_numpy(float), 0
    if rejected.max() > 10:
        line = smooth.lowess(pdf["theta"].to_numpy(float), rejected, NEAR)
        rest = (rejected - line)[rejected > 0]
        over = rejected > line.max() - np.sqrt((rest**2).mean())
        j = int(np.argmax(over)) if over.any() else 0
    return pdf.iloc[[j]][["celltype", "cut"]]


def filtered(found: DataFrame, alpha: float) -> DataFrame:
    """pb_padj after leaving out genes of low mean: Benjamini-Hochberg over the genes above a cut, chosen among CUTS quantiles of the means."""
    genes = found.where("mean IS NOT NULL").select("celltype", "gene", "mean", "pb_pvalue")
    n = genes.groupBy("celltype").agg(F.count("*").alias("genes"), F.avg((F.col("mean") == 0).cast("double")).alias("low"))
    theta = F.col("low") + (F.when(F.col("low") < HIGHEST, HIGHEST).otherwise(1.0) - F.col("low")) * F.col("j") / (CUTS - 1)
    place = (F.col("genes") - 1) * F.col("theta")
    cuts = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))).alias("j")).withColumn("theta", theta).withColumn("place", F.floor(place) + 1).withColumn("part", place - F.floor(place))
    ranked = genes.select("celltype", "mean", F.row_number().over(Window.partitionBy("celltype").orderBy("mean", "gene")).alias("place"), F.lead("mean").over(Window.partitionBy("celltype").orderBy("mean", "gene")).alias("next"))
    cuts = cuts.join(ranked, ["celltype", "place"]).select("celltype", "j", "theta", (F.col("mean") + F.col("part") * (F.coalesce("next", "mean") - F.col("mean"))).alias("cut"))
    # CUTS rows a gene at most
    tried = genes.where("pb_pvalue IS NOT NULL").select("celltype", "mean", "pb_pvalue").join(F.broadcast(cuts.select("celltype", "j", "cut")), "celltype").where("mean >= cut")
    w = Window.partitionBy("celltype", "j")
    q = F.col("pb_pvalue") * F.count("*").over(w) / F.row_number().over(w.orderBy("pb_pvalue"))
    tried = tried.withColumn("q", q).withColumn("i", F.row_number().over(w.orderBy("pb_pvalue")))
    rejected = tried.groupBy("celltype", "j").agg(F.max(F.when(F.col("q") < alpha, F.col("i"))).alias("rejected"))
    chosen = cuts.join(rejected, ["celltype", "j"], "left").fillna(0, ["rejected"]).groupBy("celltype").applyInPandas(_chosen, "celltype string, cut double")
    # cell types: few rows
    out = found.join(F.broadcast(chosen), "celltype", "left")
    return benjamini_hochberg(out, "pb_pvalue", "pb_padj", ["celltype"], family=F.col("mean") >= F.col("cut"))


def run_pseudobulk(counts: DataFrame, obs: DataFrame, var: DataFrame, min_cells_per_donor: int = 10, min_donors_per_group: int = 2, min_gene_counts: int = 10, paired: bool = False, use_t: bool = False) -> DataFrame:
    """Every cell type and gene: tested rows (those with an outlier have no p), and padded rows with the reason."""
    for name, value in (("min_cells_per_donor", min_cells_per_donor), ("min_donors_per_group", min_donors_per_group), ("min_gene_counts", min_gene_counts)):
        if value < 0:
            raise ValueError(f"{name} must not be negative")
    for name, table, columns in (("obs", obs, ("cell_id", "celltype", "donor", "cond")), ("counts", counts, ("cell_id", "gene", "n")), ("var", var, ("gene",))):
        if missing := [c for c in columns if c not in table.columns]:
            raise ValueError(f"{name} lacks {missing}")
    meta = samples(obs, min_cells_per_donor)
    gate = donor_gate(meta, min_donors_per_group)
    good = gate.where("reason = ''").select("celltype")
    meta = meta.join(F.broadcast(good), "celltype", "left_semi")
    if paired:
        apart = design_choice(meta).where("design = 'unpaired'").select("celltype")
        if not apart.isEmpty():
            raise ValueError("a paired design needs donors in both conditions: here each sample is of another donor")
    pb = gene_filter(sums(counts, obs, meta, var), min_gene_counts)
    found = test(pb, paired, use_t).withColumn("pb_tested", F.lit(True)).withColumn("pb_skip_reason", F.lit(""))
    return pad(found, gate, var)


def pad(found: DataFrame, gate: DataFrame, var: DataFrame) -> DataFrame:
    """Genes without a result get an untested row with why (fixed values): an anti-join, then a union."""
    every = gate.crossJoin(var.select("gene"))
    some = found.groupBy("celltype").agg(F.lit(True).alias("some"))
    missing = every.join(found.select("celltype", "gene"), ["celltype", "gene"], "left_anti").join(F.broadcast(some), "celltype", "left")
    why = F.when(F.col("reason") != "", F.col("reason")).when(F.col("some"), "below_min_gene_counts").otherwise("no_genes_after_count_filter")
    missing = missing.select("celltype", "gene", F.lit(False).alias("pb_tested"), why.alias("pb_skip_reason"))
    return found.unionByName(missing, allowMissingColumns=True).join(gate.drop("reason"), "celltype")


def welch(pb: DataFrame) -> DataFrame:
    """A plain sample-level statistic: Welch's t of log2 counts per million, a moments-only comparator."""
    size = F.sum("n").over(Window.partitionBy("celltype", "sample"))
    x = pb.withColumn("x", F.log2((F.col("n") + 0.5) / (size + 1.0) * 1e6))
    arm = lambda k: F.when(F.col("cond") == k, F.col("x"))
    m = x.groupBy("celltype", "gene").agg(*[f(arm(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    se = F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    return m.select("celltype", "gene", (F.col("m1") - F.col("m0")).alias("pb_log2FC"), F.try_divide(F.col("m1") - F.col("m0"), se).alias("pb_stat"))


def adjust(df: DataFrame) -> DataFrame:
    return benjamini_hochberg(df, "pb_pvalue", "pb_padj", ["celltype"])

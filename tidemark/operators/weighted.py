"""Sample-level linear models on log counts: normalisation, precision weights, and samples that share a block.

Counts of samples become log2 counts per million of normalised library sizes.  The spread of a gene's residuals
falls with its mean; a robust local regression of that trend gives each value a weight, and genes are fitted
by weighted least squares.  Everything is aggregates over (gene, sample) rows and Column algebra over genes.

The trend is fitted at ``PLACES`` evenly spaced places over the range of the means and read between them by straight lines; a
gene meets each place once in a round, so a cell type's genes are never in one task.

Samples of one block (a donor, a patient) are alike.  A gene's correlation within blocks has the greatest restricted likelihood,
which is closed in sums a block for each correlation tried (grids, each around the best of the one before); a cell type's
consensus is a trimmed mean of their inverse hyperbolic tangents, and genes are fitted again with it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native
from ..schema import average_rank
from .dealing import deal
from .kept import small
from .mixed import CELLS, _arrays

PLACES, SPAN, ROUNDS = 101, 0.5, 3
#: Shares of genes trimmed by ratio and by mean (fixed values of the method).
TRIM_RATIO, TRIM_MEAN = 0.3, 0.05
#: Points of a grid of correlations, and grids: the last has steps of about 0.0002, between which likelihoods still differ beyond rounding.
GRID, GRIDS, MOST, TRIM_CONSENSUS = 33, 3, 0.99, 0.15


def expressed(pb: DataFrame, least: int = 10, total: int = 15) -> DataFrame:
    """Rows of genes with a count of ``least`` (of a library of the median size) in as many samples as the smaller arm has, and ``total`` in all.

    Of arms with more than ten samples, seven tenths of those beyond ten count.
    """
    sizes = pb.groupBy("celltype", "sample", "cond").agg(F.sum("n").alias("lib"))
    arms = sizes.groupBy("celltype", "cond").agg(F.count("*").alias("m")).groupBy("celltype").agg(F.min("m").alias("m"))
    need = F.when(F.col("m") > 10, 10 + (F.col("m") - 10) * 0.7).otherwise(F.col("m"))
    cut = sizes.groupBy("celltype").agg((least / F.percentile("lib", 0.5) * 1e6).alias("cut")).join(arms, "celltype").select("celltype", "cut", need.alias("need"))
    rows = pb.join(F.broadcast(sizes.select("celltype", "sample", "lib")), ["celltype", "sample"]).join(F.broadcast(cut), "celltype")
    over = rows.groupBy("celltype", "gene").agg(F.count_if(F.col("n") / F.col("lib") * 1e6 >= F.col("cut")).alias("k"), F.max("need").alias("need"), F.sum("n").alias("all"))
    keep = over.where((F.col("k") >= F.col("need") - 1e-14) & (F.col("all") >= total))
    return pb.join(keep.select("celltype", "gene"), ["celltype", "gene"], "left_semi")


def library_sizes(pb: DataFrame) -> DataFrame:
    """celltype, sample, lib, factor: sums, and factors from trimmed means of log ratios to the sample whose upper quartile is nearest their mean.

    Ratios are weighted by their variances, and tie where they agree to ten decimals; the factors of a cell type have a geometric mean of 1.
    """
    some = pb.groupBy("celltype", "gene").agg(F.sum("n").alias("all")).where("all > 0").select("celltype", "gene")
    rows = pb.join(some, ["celltype", "gene"], "left_semi")
    sizes = rows.groupBy("celltype", "sample").agg(F.sum("n").cast("double").alias("lib"), (F.percentile("n", 0.75) / F.sum("n")).alias("quartile"))
    away = F.abs(F.col("quartile") - F.avg("quartile").over(Window.partitionBy("celltype")))
    first = sizes.withColumn("r", F.row_number().over(Window.partitionBy("celltype").orderBy(away, "sample"))).where("r = 1").select("celltype", "sample")
    sized = rows.where("n > 0").join(F.broadcast(sizes.select("celltype", "sample", "lib")), ["celltype", "sample"])
    ref = sized.join(F.broadcast(first), ["celltype", "sample"], "left_semi").select("celltype", "gene", F.col("n").alias("rn"), F.col("lib").alias("rlib"))
    a, b = F.col("n") / F.col("lib"), F.col("rn") / F.col("rlib")
    pairs = sized.join(ref, ["celltype", "gene"]).select("celltype", "sample", F.log2(a / b).alias("ratio"), (F.log2(a) / 2 + F.log2(b) / 2).alias("mean"), ((1 - a) / F.col("n") + (1 - b) / F.col("rn")).alias("v"))
    one = ["celltype", "sample"]
    n = F.count("*").over(Window.partitionBy(*one))
    ranked = pairs.select("*", n.alias("m"), average_rank(one, F.round("ratio", 10)).alias("r1"), average_rank(one, F.round("mean", 10)).alias("r2"))
    inside = lambda r, share: (F.col(r) >= F.floor(F.col("m") * share) + 1) & (F.col(r) <= F.col("m") - F.floor(F.col("m") * share))
    kept = ranked.where(inside("r1", TRIM_RATIO) & inside("r2", TRIM_MEAN))
    log_factor = F.when(F.max(F.abs("ratio")) < 1e-6, 0.0).otherwise(F.try_divide(F.sum(F.try_divide("ratio", "v")), F.sum(F.try_divide(F.lit(1.0), "v"))))
    factors = kept.groupBy(*one).agg(log_factor.alias("f"))
    out = sizes.join(factors, one, "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return out.select(*one, "lib", F.pow(F.lit(2.0), F.col("f") - F.avg("f").over(Window.partitionBy("celltype"))).alias("factor"))


def log_counts(pb: DataFrame, sizes: DataFrame) -> DataFrame:
    """pb with lib (normalised) and y: log2 counts per million, half a count added."""
    rows = pb.join(F.broadcast(sizes.select("celltype", "sample", (F.col("lib") * F.col("factor")).alias("lib"))), ["celltype", "sample"])
    return rows.withColumn("y", F.log2((F.col("n") + 0.5) / (F.col("lib") + 1) * 1e6))


def _arms(rows: DataFrame, w: Column, *more) -> DataFrame:
    """Sums of w, w y, w y^2 of the arms, a gene a row."""
    on = lambda j, c: F.sum(F.when(F.col("cond") == j, c).otherwise(0.0))
    y = F.col("y")
    return rows.groupBy("celltype", "gene").agg(F.count("*").alias("m"), *[on(j, c).alias(f"{k}{j}") for k, c in (("w", w), ("s", w * y), ("q", w * y * y)) for j in (0, 1)], *more)


def _fit(sums: DataFrame) -> DataFrame:
    """mean0, mean1, beta, s2, dfres, vcoef from the arms' sums; cell types whose samples are all of one arm, or two in all, drop out."""
    out = sums.where((F.col("w0") > 0) & (F.col("w1") > 0) & (F.col("m") > 2))
    rest = F.col("q0") + F.col("q1") - F.col("s0") * F.col("s0") / F.col("w0") - F.col("s1") * F.col("s1") / F.col("w1")
    return out.withColumns({"mean0": F.col("s0") / F.col("w0"), "mean1": F.col("s1") / F.col("w1")}).withColumns({
        "beta": F.col("mean1") - F.col("mean0"), "s2": F.greatest(rest, F.lit(0.0)) / (F.col("m") - 2), "dfres": F.col("m") - 2, "vcoef": 1 / F.col("w0") + 1 / F.col("w1"),
    })


def trend_points(rows: DataFrame) -> DataFrame:
    """celltype, gene, x, y, mean0, mean1: a gene's mean log count and the root of its residual deviation; rows of ``log_counts``."""
    lib = F.log2(F.col("lib") + 1)
    fit = _fit(_arms(rows, F.lit(1.0), F.avg("y").alias("a"), F.avg(lib).alias("l")))
    return fit.select("celltype", "gene", (F.col("a") + F.col("l") - math.log2(1e6)).alias("x"), F.sqrt(F.sqrt("s2")).alias("y"), "mean0", "mean1")


def _between(x: Column) -> Column:
    """The trend at x from ``curve`` (values at evenly spaced places from lo, step apart), level beyond its ends."""
    at = F.least(F.greatest((x - F.col("lo")) / F.col("step"), F.lit(0.0)), F.lit(PLACES - 1.0))
    j = F.least(F.floor(at), F.lit(PLACES - 2)).cast("int")
    return F.get("curve", j) + (at - j) * (F.get("curve", j + 1) - F.get("curve", j))


def trend(points: DataFrame, span: float = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """celltype, lo, step, curve: robust local lines of y by x, over the nearest ``span`` of the genes at each place.

    Between rounds the driver holds PLACES rows a cell type; ``points`` is read several times and best a written table.
    """
    order = Window.partitionBy("celltype").orderBy("x", "gene")
    sizes = points.groupBy("celltype").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("genes"))
    sizes = sizes.withColumn("step", (F.col("hi") - F.col("lo")) / (PLACES - 1)).withColumn("k", F.greatest(F.least("genes", F.floor(span * F.col("genes") + 1e-7)), F.lit(2)))
    sizes = small(sizes.where((F.col("step") > 0) & (F.col("genes") >= 2)))
    places = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("j")).withColumn("a", F.col("lo") + F.col("j") * F.col("step"))
    # a place's bandwidth: the narrowest run of k genes in order that holds it, by its farther end
    numbered = points.select("celltype", "x", F.row_number().over(order).alias("r"))
    ends = numbered.alias("f").join(F.broadcast(sizes.select("celltype", "k")), "celltype").select("celltype", F.col("x").alias("first"), (F.col("r") + F.col("k") - 1).alias("r"))
    runs = ends.join(numbered.withColumnRenamed("x", "last"), ["celltype", "r"]).select("celltype", "first", "last")
    width = runs.join(F.broadcast(places.select("celltype", "j", "a")), "celltype").groupBy("celltype", "j").agg(F.min(F.greatest(F.col("a") - F.col("first"), F.col("last") - F.col("a"))).alias("h"))
    places = small(places.join(width, ["celltype", "j"]).select("celltype", "j", "a", "h", "lo", "hi", "step"))
    genes, curve = points.select("celltype", "x", "y").withColumn("trust", F.lit(1.0)), None
    for k in range(rounds + 1):
        r = F.abs(F.col("x") - F.col("a"))
        cube = F.pow(1 - F.pow(r / F.col("h"), F.lit(3.0)), F.lit(3.0))
        w = F.col("trust") * F.when(r <= 0.001 * F.col("h"), 1.0).when(r <= 0.999 * F.col("h"), cube).otherwise(0.0)
        # PLACES rows a gene
        met = genes.join(F.broadcast(places), "celltype").withColumn("w", w).where("w > 0")
        x, y = F.col("x") - F.col("a"), F.col("y")
        sums = met.groupBy("celltype", "j").agg(*[F.sum(F.col("w") * c).alias(n) for n, c in (("t0", F.lit(1.0)), ("t1", x), ("t2", x * x), ("ty", y), ("txy", x * y))], F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("step").alias("step"))
        center, spread = F.col("t1") / F.col("t0"), F.col("t2") / F.col("t0") - F.col("t1") / F.col("t0") * F.col("t1") / F.col("t0")
        slope = F.when(F.sqrt(F.greatest(spread, F.lit(0.0))) > 0.001 * (F.col("hi") - F.col("lo")), (F.col("txy") / F.col("t0") - center * F.col("ty") / F.col("t0")) / spread).otherwise(0.0)
        fits = sums.select("celltype", "j", "lo", "step", (F.col("ty") / F.col("t0") - slope * center).alias("fit"))
        curve = fits.groupBy("celltype").agg(F.first("lo").alias("lo"), F.first("step").alias("step"), F.transform(F.array_sort(F.collect_list(F.struct("j", "fit"))), lambda c: c["fit"]).alias("curve"))
        curve = small(curve.where(F.size("curve") == PLACES))
        if k == rounds:
            break
        rest = points.join(F.broadcast(curve), "celltype").select("celltype", "x", "y", F.abs(F.col("y") - _between(F.col("x"))).alias("rest"))
        scale = small(rest.groupBy("celltype").agg((6 * F.percentile("rest", 0.5)).alias("c"), F.avg("rest").alias("m")))
        u = F.col("rest") / F.col("c")
        trust = F.when((F.col("c") <= 1e-7 * F.col("m")) | (u <= 0.001), 1.0).when(u <= 0.999, (1 - u * u) * (1 - u * u)).otherwise(0.0)
        genes = rest.join(F.broadcast(scale), "celltype").select("celltype", "x", "y", trust.alias("trust"))
    return curve


def weights(rows: DataFrame, points: DataFrame, curve: DataFrame) -> DataFrame:
    """rows with w: the trend at a value's fitted log count, to the power -4."""
    fitted = F.when(F.col("cond") == 0, F.col("mean0")).otherwise(F.col("mean1")) + F.log2(F.col("lib") + 1) - math.log2(1e6)
    joined = rows.join(points.select("celltype", "gene", "mean0", "mean1"), ["celltype", "gene"]).join(F.broadcast(curve), "celltype")
    return joined.withColumn("w", F.pow(_between(fitted), F.lit(-4.0))).drop("mean0", "mean1", "lo", "step", "curve")


def weighted_fit(rows: DataFrame) -> DataFrame:
    """celltype, gene, beta, s2, dfres, vcoef, t of rows with w."""
    return _fit(_arms(rows, F.col("w"))).withColumn("t", F.try_divide("beta", F.sqrt(F.col("s2") * F.col("vcoef")))).select("celltype", "gene", "beta", "s2", "dfres", "vcoef", "t")


def moderated(fits: DataFrame, priors: DataFrame) -> DataFrame:
    """fits with moderated t, its degrees of freedom (those of all genes together at most) and p; ``priors``: celltype, d0, s02."""
    joined = fits.join(F.broadcast(priors), "celltype", "left")
    post = F.when(F.col("d0").isNull(), F.col("s2")).otherwise((F.col("d0") * F.col("s02") + F.col("dfres") * F.col("s2")) / (F.col("d0") + F.col("dfres")))
    pooled = F.sum("dfres").over(Window.partitionBy("celltype"))
    out = joined.withColumn("t", F.try_divide("beta", F.sqrt(post * F.col("vcoef")))).withColumn("df", F.least(F.col("dfres") + F.coalesce("d0", F.lit(0.0)), pooled))
    return out.withColumn("pvalue", F.exp(native.t_log_two_sided(F.col("t"), F.col("df")))).drop("d0", "s02")


# ---------------------------------------------------------------- blocks


def block_sums(rows: DataFrame, block: str = "donor") -> DataFrame:
    """celltype, gene, blocks: an array with weights v, v1 (second arm), sums of w y (s, s1) and w y^2 (q) of each block, and its samples n."""
    w, y, second = F.col("w"), F.col("y"), F.col("cond") == 1
    only = lambda c: F.sum(F.when(second, c).otherwise(0.0))
    one = rows.groupBy("celltype", "gene", F.col(block).cast("string").alias("block")).agg(F.sum(w).alias("v"), only(w).alias("v1"), F.sum(w * y).alias("s"), only(w * y).alias("s1"), F.sum(w * y * y).alias("q"), F.count("*").alias("n"))
    return one.groupBy("celltype", "gene").agg(F.array_sort(F.collect_list(F.struct("block", "v", "v1", "s", "s1", "q", "n"))).alias("blocks"))


def _restricted(ratio: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
    """Restricted log-likelihoods, without their constant, of ratios (genes x tried) of block to residual variance; -inf where a covariance isn't one."""
    v, v1, s, s1, q, n = (x[k][:, None, :] for k in ("v", "v1", "s", "s1", "q", "n"))
    one = 1 + ratio[:, :, None] * v
    c = ratio[:, :, None] / one
    a, b, d = (t.sum(2) for t in (v - c * v * v, v1 - c * v * v1, v1 - c * v1 * v1))
    e, f, g = (t.sum(2) for t in (s - c * v * s, s1 - c * v1 * s, q - c * s * s))
    det = a * d - b * b
    rest = g - (e * (d * e - b * f) + f * (a * f - b * e)) / det
    value = -0.5 * (np.log(one).sum(2) + np.log(det) + (n.sum(2) - 2) * np.log(rest))
    return np.where((one > 0).all(2) & (det > 0) & (rest > 0), value, -np.inf)


def _best_correlation(x: dict[str, np.ndarray]) -> np.ndarray:
    most = x["n"].max(1)
    low, high = np.maximum(1 / (1 - np.maximum(most, 1.5)) + 0.01, -MOST), np.full(len(most), MOST)
    rho = low
    for _ in range(GRIDS):
        step = (high - low) / (GRID - 1)
        tried = low[:, None] + np.arange(GRID) * step[:, None]
        at = _restricted(tried / (1 - tried), x).argmax(1)
        rho = tried[np.arange(len(at)), at]
        low, high = np.maximum(rho - step, low), np.minimum(rho + step, high)
    return np.where(most > 1, rho, np.nan)


def correlations(blocks: DataFrame) -> DataFrame:
    """celltype, gene, rho: the correlation within blocks of greatest restricted likelihood, from just above the least one that blocks of that size can have.

    Genes are dealt out and tried in Arrow batches; null where no block has two samples.
    """

    def run(batches):
        for b in batches:
            lists = b.column("blocks")
            step = max(1, CELLS // (GRID * max(1, int(np.diff(lists.offsets.to_numpy()).max(initial=1)))))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                held = part.column("blocks")
                x, _ = _arrays(pa.ListArray.from_arrays(pa.array(held.offsets.to_numpy() - held.offsets[0].as_py()), held.flatten()))
                with np.errstate(all="ignore"):
                    rho = _best_correlation(x)
                yield pa.RecordBatch.from_arrays([part.column("celltype"), part.column("gene"), pa.array(rho, from_pandas=True)], ["celltype", "gene", "rho"])

    return deal(blocks, "celltype", "gene").select("celltype", "gene", "blocks").mapInArrow(run, "celltype string, gene string, rho double")


def consensus(found: DataFrame) -> DataFrame:
    """celltype, rho: back from the mean of the inverse hyperbolic tangents without 15 % of the genes at either end."""
    some = found.where(F.col("rho").isNotNull()).withColumn("z", 0.5 * F.ln((1 + F.col("rho")) / (1 - F.col("rho"))))
    cut = F.floor(F.count("*").over(Window.partitionBy("celltype")) * TRIM_CONSENSUS)
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("celltype").orderBy("z", "gene"))).withColumn("left", cut).withColumn("m", F.count("*").over(Window.partitionBy("celltype")))
    return ranked.where((F.col("r") > F.col("left")) & (F.col("r") <= F.col("m") - F.col("left"))).groupBy("celltype").agg(F.tanh(F.avg("z")).alias("rho"))


def blocked_fit(rows: DataFrame, rho: DataFrame, block: str = "donor") -> DataFrame:
    """celltype, gene, beta, s2, dfres, vcoef, t: generalised least squares, samples of a block correlated by ``rho`` (celltype, rho) after weighting."""
    w, y = F.col("w"), F.col("y")
    arm = F.col("cond").cast("double")
    root = F.sqrt(w)
    one = rows.groupBy("celltype", "gene", F.col(block).alias("block")).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (("u", root), ("u1", root * arm), ("z", root * y), ("a", w), ("b", w * arm), ("d", w * y), ("e", w * arm * y), ("q", w * y * y))]
    )
    one = one.join(F.broadcast(rho), "celltype").withColumn("c", F.col("rho") / (1 + (F.col("n") - 1) * F.col("rho")))
    c = F.col("c")
    less = {"a": ("u", "u"), "b": ("u", "u1"), "c1": ("u1", "u1"), "d": ("u", "z"), "e": ("u1", "z"), "q": ("z", "z")}
    plain = {"a": "a", "b": "b", "c1": "b", "d": "d", "e": "e", "q": "q"}
    sums = one.groupBy("celltype", "gene").agg(F.sum("n").alias("m"), *[(F.sum(F.col(plain[k]) - c * F.col(i) * F.col(j)) / (1 - F.first("rho"))).alias(f"g_{k}") for k, (i, j) in less.items()])
    a, b, c1, d, e, q = (F.col(f"g_{k}") for k in ("a", "b", "c1", "d", "e", "q"))
    det = a * c1 - b * b
    out = sums.where((F.col("m") > 2) & (det > 0)).withColumns({"beta": (a * e - b * d) / det, "b0": (c1 * d - b * e) / det, "vcoef": a / det, "dfres": F.col("m") - 2})
    out = out.withColumn("s2", F.greatest(q - F.col("b0") * d - F.col("beta") * e, F.lit(0.0)) / F.col("dfres"))
    return out.withColumn("t", F.try_divide("beta", F.sqrt(F.col("s2") * F.col("vcoef")))).select("celltype", "gene", "beta", "s2", "dfres", "vcoef", "t")

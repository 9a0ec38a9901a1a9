"""Methods side by side: harmonised tables, concordance, consensus, discordance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HARMON, average_rank


def harmonise(df: DataFrame, method: str, comparison: str = "") -> DataFrame:
    """A method's result under the common columns; what it lacks is null."""
    have = set(df.columns)
    pick = {"pvalue": ("pvalue", "pb_pvalue"), "fdr": ("fdr", "pb_padj"), "log2fc": ("log2fc", "pb_log2FC", "coef"), "neglog10p": ("neglog10p", "pb_neglog10p"), "stat": ("stat", "stat_hurdle", "pb_stat"),
            "n_ref": ("n_ref", "n_donors_ref"), "n_test": ("n_test", "n_donors_test"), "tested": ("tested", "pb_tested"), "skip_reason": ("skip_reason", "pb_skip_reason")}
    kinds = {"tested": "boolean", "skip_reason": "string", "n_ref": "long", "n_test": "long"}
    out = []
    for c in HARMON:
        if c in ("method", "comparison"):
            out.append(F.lit(method if c == "method" else comparison).alias(c))
        elif c in ("celltype", "gene"):
            out.append(F.col(c).cast("string").alias(c))
        else:
            found = next((x for x in pick[c] if x in have), None)
            out.append((F.col(found) if found else F.lit(None)).cast(kinds.get(c, "double")).alias(c))
    return df.select(*out)


def wide(methods: dict[str, DataFrame], values: list[str]) -> DataFrame:
    """One row a cell type and gene; each method's values under its name, by outer joins."""
    parts = [df.select("celltype", "gene", *[F.col(v).alias(f"{v}_{m}") for v in values]) for m, df in methods.items()]
    return reduce(lambda a, b: a.join(b, ["celltype", "gene"], "full_outer"), parts)


def common_genes(df: DataFrame, n_methods: int) -> DataFrame:
    """Genes that every method tested."""
    return df.where("tested").groupBy("celltype", "gene").agg(F.count_distinct("method").alias("k")).where(F.col("k") == n_methods).drop("k")


def top_k(df: DataFrame, score: str, k: int, by: list[str], tie: str = "gene") -> DataFrame:
    """The k highest of each group; ties by name."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def concordance(a: DataFrame, b: DataFrame, k: int = 20, alpha: float = 0.05, least: int = 5) -> DataFrame:
    """Per cell type: Pearson and Spearman of effects, Spearman of evidence, sign agreement, Jaccard of calls, top-k overlap."""
    one = a.select("celltype", "gene", F.col("log2fc").alias("x"), F.col("neglog10p").alias("p"), (F.col("fdr") < alpha).alias("s"))
    two = b.select("celltype", "gene", F.col("log2fc").alias("y"), F.col("neglog10p").alias("q"), (F.col("fdr") < alpha).alias("t"))
    for df, name in ((one, "p"), (two, "q")):
        rank = Window.partitionBy("celltype").orderBy(F.col(name).desc_nulls_last(), "gene")
        if name == "p":
            one = df.withColumn("top1", F.row_number().over(rank) <= k)
        else:
            two = df.withColumn("top2", F.row_number().over(rank) <= k)
    j = one.join(two, ["celltype", "gene"]).where("x IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL")
    for c in ("x", "y", "p", "q"):
        j = j.withColumn(f"r{c}", average_rank(["celltype"], F.col(c)))
    n = F.count("*")
    enough = lambda c: F.when(n >= least, c)
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return j.groupBy("celltype").agg(
        n.alias("n_genes"),
        enough(F.corr("x", "y")).alias("pearson_log2fc"), enough(F.corr("rx", "ry")).alias("spearman_log2fc"), enough(F.corr("rp", "rq")).alias("spearman_neglog10p"),
        F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_agreement"),
        F.try_divide(yes(F.col("s") & F.col("t")), yes(F.col("s") | F.col("t"))).alias("jaccard"),
        yes(F.col("top1") & F.col("top2")).alias("topk_overlap"),
    )


def consensus(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per gene: methods that tested it, that call it, whether their signs agree."""
    sig = F.coalesce(F.col("fdr") < alpha, F.lit(False))
    return df.groupBy("celltype", "gene").agg(
        F.count_if("tested").alias("n_methods_tested"), F.count_if(sig).alias("n_methods_sig"),
        F.array_join(F.array_sort(F.collect_set(F.when(sig, F.col("method")))), ",").alias("methods_sig"),
        (F.count_distinct(F.when(sig, F.signum("log2fc"))) <= 1).alias("same_direction"),
    )


def changed_calls(a: DataFrame, b: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Genes that one table calls and the other doesn't: a symmetric difference with the side."""
    one = a.select("celltype", "gene", F.coalesce(F.col("fdr") < alpha, F.lit(False)).alias("sig_a"))
    two = b.select("celltype", "gene", F.coalesce(F.col("fdr") < alpha, F.lit(False)).alias("sig_b"))
    j = one.join(two, ["celltype", "gene"], "full_outer").fillna(False, ["sig_a", "sig_b"])
    return j.where("sig_a <> sig_b").withColumn("only_in", F.when(F.col("sig_a"), "a").otherwise("b"))


def relative_difference(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def aligned(genes: DataFrame, result: DataFrame, place: str) -> DataFrame:
    """A result's rows for a list of genes, in a left join: of repeated genes the row that is first by ``place``, null where there is none."""
    w = Window.partitionBy("celltype", "gene").orderBy(place)
    first = result.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return genes.join(first, ["celltype", "gene"], "left")


def stable_top_k(df: DataFrame, score: Column, place: str, k: int, by: list[str]) -> DataFrame:
    """The k least of each group by ``score`` (nulls last), ties in the order of ``place``, as a stable sort leaves them."""
    w = Window.partitionBy(*by).orderBy(score.asc_nulls_last(), place)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def order_overlap(df: DataFrame, p: str, stat: str, k: int, orders: int, seed: int = 0) -> DataFrame:
    """How far the k best genes of a cell type hang on the order of its rows, over ``orders`` orders (the first by name, the others by
    a hash): genes that the best by p (ties stay in that order) and the best by the statistic share, at least, in the median and at
    most; the least Jaccard overlap of the best by p between one order and the next; and whether the best by the statistic are the same in all."""
    place = F.when(F.col("run") == 0, F.col("gene")).otherwise(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("run").cast("string"), "gene")))
    runs = df.select("celltype", "gene", p, stat, F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("run")).withColumn("_place", place)
    by = ["celltype", "run"]
    a = stable_top_k(runs, F.col(p), "_place", k, by).select(*by, "gene", F.lit(1).alias("p"))
    b = stable_top_k(runs, -F.col(stat), "_place", k, by).select(*by, "gene", F.col("rank").alias("s"))
    n = a.join(b, [*by, "gene"], "full_outer").groupBy(*by).agg(F.count(F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), 1)).alias("shared"), F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "gene")))).alias("_s"), F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.col("gene")))).alias("_p"))
    w = Window.partitionBy("celltype").orderBy("run")
    before = F.lag("_p").over(w)
    n = n.withColumn("_j", F.when(before.isNotNull(), F.try_divide(F.size(F.array_intersect("_p", before)), F.size(F.array_union("_p", before)))))
    return n.groupBy("celltype").agg(
        F.min("shared").alias("overlap_min"), F.median("shared").alias("overlap_median"), F.max("shared").alias("overlap_max"),
        F.coalesce(F.min("_j"), F.lit(1.0)).alias("jaccard_min"), (F.count_distinct(F.to_json("_s")) == 1).alias("statistic_identical"),
    )


def pairwise(df: DataFrame, methods: list[str], k: int = 100, alpha: float = 0.05) -> DataFrame:
    """``concordance`` of every two methods' tested genes, five in common at least, with the calls of either."""
    tested = df.where("tested")
    out = None
    for i, a in enumerate(methods):
        for b in methods[i + 1 :]:
            one, two = tested.where(F.col("method") == a), tested.where(F.col("method") == b)
            calls = [x.groupBy("celltype").agg(F.count_if(F.col("fdr") < alpha).alias(n)) for x, n in ((one, "sig_a"), (two, "sig_b"))]
            c = concordance(one, two, k, alpha).where("n_genes >= 5").join(calls[0], "celltype").join(calls[1], "celltype")
            c = c.select("celltype", F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), *[x for x in c.columns if x != "celltype"])
            out = c if out is None else out.unionByName(c)
    if out is None:
        raise ValueError("a comparison needs two methods")
    return out


def agreement(a: DataFrame, b: DataFrame, value: str, tolerance: float = 1e-3) -> DataFrame:
    """Per cell type: greatest and median absolute and relative difference, share within tolerance, the worst gene and the worst three."""
    j = a.select("celltype", "gene", F.col(value).alias("a")).join(b.select("celltype", "gene", F.col(value).alias("b")), ["celltype", "gene"]).dropna(subset=["a", "b"])
    j = j.withColumn("d", F.abs(F.col("a") - F.col("b"))).withColumn("r", relative_difference(F.col("a"), F.col("b")))
    three = j.withColumn("_k", F.row_number().over(Window.partitionBy("celltype").orderBy(F.desc("r"), F.desc("gene")))).where("_k <= 3").groupBy("celltype").agg(F.array_sort(F.collect_list(F.struct("_k", "gene"))).alias("_worst"))
    out = j.groupBy("celltype").agg(
        F.count("*").alias("n"), F.max("d").alias("max_abs"), F.median("d").alias("median_abs"), F.max("r").alias("max_rel"), F.median("r").alias("median_rel"),
        F.avg((F.col("r") <= tolerance).cast("double")).alias("within"), F.max_by("gene", F.struct("r", "gene")).alias("worst_gene"),
    )
    return out.join(three, "celltype").withColumn("worst_genes", F.array_join(F.col("_worst.gene"), ";")).drop("_worst")


def missing_with_reason(genes: DataFrame, result: DataFrame) -> DataFrame:
    """Genes that a method didn't test, with its reason ('absent' where it has no row)."""
    tested = result.where("tested").select("celltype", "gene")
    lost = genes.join(tested, ["celltype", "gene"], "left_anti")
    return lost.join(result.select("celltype", "gene", "skip_reason"), ["celltype", "gene"], "left").fillna("absent", ["skip_reason"])


def sensitivity(a: DataFrame, b: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two runs of one test (other order, other engine): greatest changes, changed calls, whether all is identical."""
    one = a.select("celltype", "gene", F.col("log2fc").alias("x"), F.col("neglog10p").alias("p"), F.col("fdr").alias("f"))
    two = b.select("celltype", "gene", F.col("log2fc").alias("y"), F.col("neglog10p").alias("q"), F.col("fdr").alias("g"))
    j = one.join(two, ["celltype", "gene"])
    sig = lambda c: F.coalesce(F.col(c) < alpha, F.lit(False))
    return j.groupBy("celltype").agg(
        F.count("*").alias("n_genes"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_log2fc"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_neglog10p"), F.max(F.abs(F.col("f") - F.col("g"))).alias("max_fdr"),
        F.count_if(sig("f") != sig("g")).alias("changed_calls"), F.bool_and(F.col("x").eqNullSafe(F.col("y")) & F.col("p").eqNullSafe(F.col("q")) & F.col("f").eqNullSafe(F.col("g"))).alias("identical"),
    )


def boundary_reason(fdr_a: Column, fdr_b: Column, alpha: float = 0.05, near: float = 0.2) -> Column:
    """Why a gene is called by one run only: untested in one, near the threshold in both, or a real difference."""
    close = lambda q: F.abs(q - alpha) <= near * alpha
    return F.when(fdr_a.isNull() | fdr_b.isNull(), "untested_in_one").when(close(fdr_a) & close(fdr_b), "near_boundary").otherwise("different")


def refit_summary(full: DataFrame, part: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A fit on fewer samples against the full one: calls kept, lost and gained, correlation and median change of effects."""
    j = full.select("celltype", "gene", F.col("log2fc").alias("x"), F.coalesce(F.col("fdr") < alpha, F.lit(False)).alias("s")).join(
        part.select("celltype", "gene", F.col("log2fc").alias("y"), F.coalesce(F.col("fdr") < alpha, F.lit(False)).alias("t")), ["celltype", "gene"]
    )
    both, either = F.count_if(F.col("s") & F.col("t")), F.count_if(F.col("s") | F.col("t"))
    return j.groupBy("celltype").agg(
        F.try_divide(both, either).alias("jaccard"), F.count_if(F.col("s") & ~F.col("t")).alias("lost"), F.count_if(~F.col("s") & F.col("t")).alias("gained"),
        F.corr("x", "y").alias("pearson"), F.median(F.abs(F.col("x") - F.col("y"))).alias("median_change"),
    )


def verdict(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Claims (name, value) against expectations (name, expected, tolerance): OK, MISMATCH, or MISSING."""
    j = expected.join(found, "name", "left")
    ok = F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance")
    return j.withColumn("status", F.when(F.col("value").isNull(), "MISSING").when(ok, "OK").otherwise("MISMATCH"))

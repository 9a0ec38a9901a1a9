"""Null calibration: permuted labels, donor splits, stratified samples, variance between donors."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _places(df: DataFrame, part: Column, *order: Column | str) -> DataFrame:
    """``_k``: the row's number within its cell type.  ``part`` deals a type's rows into parts that follow each other in
    that order, so that a type is numbered by many tasks: within its part, after all rows of the parts before."""
    dealt = df.withColumn("_part", part)
    sizes = dealt.groupBy("celltype", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("celltype").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    within = F.row_number().over(Window.partitionBy("celltype", "_part").orderBy(*order))
    return dealt.withColumn("_r", within).join(sizes.select("celltype", "_part", before.alias("_before")), ["celltype", "_part"]).withColumn("_k", F.col("_before") + F.col("_r")).drop("_part", "_r", "_before")


def permuted(obs: DataFrame, seed: int = 0, cuts: int = 255) -> DataFrame:
    """Labels dealt anew within each cell type: the k-th cell by one hash gets the label of the k-th by id.

    Hashes are dealt into parts by their first three digits, ids by ``cuts`` ids a cell type, those of least hash.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string")))
    a = _places(obs.withColumn("_key", key), F.substring("_key", 1, 3), "_key", "cell_id").drop("cond", "_key")
    marks = stratified(obs.select("celltype", "cell_id"), ["celltype"], cuts, seed).groupBy("celltype").agg(F.collect_list("cell_id").alias("_marks"))
    b = obs.select("celltype", "cell_id", "cond").join(marks, "celltype")
    b = _places(b, F.size(F.filter("_marks", lambda m: m <= F.col("cell_id"))), "cell_id").select("celltype", "cond", "_k")
    return a.join(b, ["celltype", "_k"]).drop("_k")


def donor_splits(donors: list, most: int) -> list[list[tuple]]:
    """Ways to deal donors into two equal arms, mirror images once (the first donor stays in arm 0); an odd one is
    left out in turn.  All ways have to be ``most`` at most: their number grows as that of combinations (``random_splits``
    draws from more donors)."""
    donors = sorted(donors)
    if n_donor_splits(len(donors)) > most:
        raise ValueError(f"{len(donors)} donors have {n_donor_splits(len(donors))} splits, more than {most}: draw some by random_splits")
    sets = [donors] if len(donors) % 2 == 0 else [donors[:i] + donors[i + 1 :] for i in range(len(donors))]
    found = []
    for group in sets:
        half = len(group) // 2
        for rest in combinations(group[1:], half - 1):
            arm = {group[0], *rest}
            found.append([(d, 0 if d in arm else 1) for d in group])
    return found


def n_donor_splits(n: int) -> int:
    """How many ``donor_splits`` there are: for each donor who may stay out, the companions that the least of the others can have in its arm."""
    if n < 2:
        return 0
    dealt, left_out = n - n % 2, n if n % 2 else 1
    return left_out * comb(dealt - 1, dealt // 2 - 1)


def split_table(spark: SparkSession, splits: list[list[tuple]]) -> DataFrame:
    return spark.createDataFrame([(i, d, arm) for i, s in enumerate(splits) for d, arm in s], "split_id int, donor long, arm int")


def eligible_donors(obs: DataFrame, least: int = 10) -> DataFrame:
    """Donors with ``least`` cells or more."""
    return obs.groupBy("donor").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("donor")


def random_splits(donors: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(split_id, donor, arm): up to ``most`` different equal splits of all donors, never listing all there are.

    Draw k orders the donors by a hash of (seed, k, donor): the first half is one arm, the second the other, an odd donor
    stays out.  The arm with the least donor is arm 0, so that mirror images are one; of equal draws the first counts.  Four
    draws are made for each split asked for: few donors may give fewer splits.
    """
    spark = donors.sparkSession
    draws = donors.select("donor").distinct().crossJoin(F.broadcast(spark.range(4 * most).select(F.col("id").cast("int").alias("split_id"))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("split_id").cast("string"), F.col("donor").cast("string")))
    each = Window.partitionBy("split_id")
    dealt = draws.withColumn("r", F.row_number().over(each.orderBy(key, "donor"))).withColumn("half", F.floor(F.count("*").over(each) / 2))
    dealt = dealt.where(F.col("r") <= 2 * F.col("half")).withColumn("arm", (F.col("r") > F.col("half")).cast("int"))
    dealt = dealt.withColumn("arm", F.abs(F.col("arm") - F.min_by("arm", "donor").over(each)))
    drawn = dealt.groupBy("split_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("donor").cast("string"), F.col("arm").cast("string")))), ","), 256).alias("same"))
    first = drawn.groupBy("same").agg(F.min("split_id").alias("split_id")).orderBy("split_id").limit(most)
    return dealt.join(F.broadcast(first.select("split_id")), "split_id").select("split_id", "donor", "arm")


def swapped(obs: DataFrame, splits: DataFrame) -> DataFrame:
    """Every split's cells in one table: the arm becomes the condition."""
    return obs.drop("cond").join(splits.withColumnRenamed("arm", "cond"), "donor")


def split_statistics(expr: DataFrame, obs: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sufficient statistics, sizes) of every split, for ``hurdle.densify``; celltype is ``split_id:celltype``.

    Cells are read once: statistics are made a donor, and those of its arm's donors are added up for each split.
    """
    cells = obs.select("cell_id", F.col("celltype").cast("string").alias("celltype"), "donor")
    v = F.col("value")
    made = expr.where(v > 0).join(cells, "cell_id").groupBy("celltype", "donor", "gene").agg(F.count("*").alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    scope = F.concat_ws(":", F.col("split_id").cast("string"), F.col("celltype")).alias("celltype")
    arm = lambda k, c: F.sum(F.when(F.col("arm") == k, F.col(c)).otherwise(0)).alias(f"{c}_{'test' if k else 'ref'}")
    suff = made.join(splits, "donor").groupBy(scope, "gene").agg(*[arm(k, c) for c in "csq" for k in (0, 1)])
    n = cells.groupBy("celltype", "donor").agg(F.count("*").alias("n"))
    sizes = n.join(splits, "donor").groupBy(scope).agg(arm(0, "n"), arm(1, "n"), F.sum("n").alias("n_cells"))
    return suff, sizes


def discoveries(tested: DataFrame, listed: Column, alpha: float = 0.05) -> DataFrame:
    """Per split and cell type (split_id, celltype, gene, fdr; null where not tested): genes tested and found, of all and of
    those ``listed``, the listed ones found, the share found in per cent, and whether any was."""
    found, on = F.coalesce(F.col("fdr") < alpha, F.lit(False)), F.coalesce(listed, F.lit(False))
    known = F.col("fdr").isNotNull()
    out = tested.groupBy("split_id", "celltype").agg(
        F.count_if(known).alias("n_tested"), F.count_if(known & on).alias("n_tested_listed"), F.count_if(found).alias("n_discoveries"), F.count_if(found & on).alias("n_discoveries_listed"),
        F.array_join(F.array_sort(F.collect_set(F.when(found & on, F.col("gene")))), ";").alias("listed_discoveries"),
    )
    return out.withColumn("rejection_pct", 100.0 * F.col("n_discoveries") / F.greatest(F.col("n_tested"), F.lit(1))).withColumn("any_discovery", F.col("n_discoveries") > 0)


def stratified(obs: DataFrame, by: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, by a hash of the id."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string")))
    return obs.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(key, "cell_id"))).where(F.col("_r") <= n).drop("_r")


def design_effect(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """Per cell type and gene: variance within and between donors, intraclass correlation, design effect; zeros by counts."""
    n = obs.groupBy("celltype", "donor").agg(F.count("*").alias("n"))
    x = expr.join(obs.select("cell_id", "celltype", "donor"), "cell_id").groupBy("celltype", "donor", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    # donors without any value of a gene have mean 0: their cells come in by totals
    total = n.groupBy("celltype").agg(F.sum("n").alias("cells"), F.count("*").alias("donors"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    g = x.join(n, ["celltype", "donor"]).groupBy("celltype", "gene").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    j = g.join(F.broadcast(total), "celltype")
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("cells")) / (F.col("donors") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("cells") - F.col("donors"))
    n0 = (F.col("cells") - F.col("n2") / F.col("cells")) / (F.col("donors") - 1)
    j = j.select("celltype", "gene", between.alias("ms_between"), within.alias("ms_within"), n0.alias("n0"))
    var_b = F.greatest(F.lit(0.0), (F.col("ms_between") - F.col("ms_within")) / F.col("n0"))
    icc = F.try_divide(var_b, var_b + F.col("ms_within"))
    return j.withColumn("icc", icc).withColumn("design_effect", 1 + (F.col("n0") - 1) * F.col("icc"))


def arm_offset(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """Donor-level pooled two-sample t of each donor's mean of all values, and the standardised difference of cells."""
    cell = obs.join(expr.groupBy("cell_id").agg(F.sum("value").alias("v")), "cell_id", "left").fillna(0.0, ["v"])
    donor = cell.groupBy("celltype", "donor", "cond").agg(F.avg("v").alias("m"))

    def two(df: DataFrame, c: str) -> DataFrame:
        arm = lambda k: F.when(F.col("cond") == k, F.col(c))
        return df.groupBy("celltype").agg(*[f(arm(k)).alias(f"{a}{k}") for k in (0, 1) for a, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])

    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    t = (F.col("m1") - F.col("m0")) / (pooled * F.sqrt(1.0 / F.col("n0") + 1.0 / F.col("n1")))
    d = two(donor, "m").select("celltype", t.alias("donor_t"))
    return d.join(two(cell, "v").select("celltype", ((F.col("m1") - F.col("m0")) / pooled).alias("cell_d")), "celltype")


def bootstrap_mean(df: DataFrame, value: str, by: list[str], resamples: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean of each group: by, mean, low, high.

    Resample k of a group of n values takes, for each of its n places, the value whose number (in order of value) is a hash of
    (seed, k, place) modulo n: the same draws on every run and in any plan.  Places are dealt out as rows, and one
    aggregate adds up all resamples; a group without values has nulls.
    """
    x = df.select(*by, F.col(value).cast("double").alias("_x"))
    have = x.where(F.col("_x").isNotNull())
    numbered = have.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_x")) - 1)
    sizes = have.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_x").alias("mean"))
    places = sizes.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_k").cast("string"), F.col("_j").cast("string"))), 1, 12), 16, 10).cast("long") % F.col("_n")
    picked = places.select(*by, "_k", drawn.alias("_i")).groupBy(*by, "_k", "_i").agg(F.count("*").alias("_w"))
    means = picked.join(numbered, [*by, "_i"]).groupBy(*by, "_k").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*by).agg(F.percentile("_m", tail).alias("low"), F.percentile("_m", 1 - tail).alias("high"))
    every = x.select(*by).distinct()
    for part in (sizes.drop("_n"), bounds):
        every = every.join(part, by, "left")
    return every.select(*by, "mean", "low", "high")

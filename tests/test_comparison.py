import math
import random

import pytest
from pyspark.sql import functions as F
from test_engine import toy
from tidemark.functions import columns
from tidemark.operators import compare, condition, hurdle, prep, ranksum
from tidemark.plans import api, comparison, steps
from tidemark.sources import readers


def test_order_overlap_against_stable_sorts(spark):
    import hashlib

    made = random.Random(3)
    rows = [("T", f"g{k:02d}", round(made.random(), 1), made.random()) for k in range(40)]
    got = compare.order_overlap(spark.createDataFrame(rows, "celltype string, gene string, p double, stat double"), "p", "stat", 8, 4).first()
    shared, best, top = [], [], []
    for run in range(4):
        place = (lambda g: g) if run == 0 else (lambda g, run=run: hashlib.md5(f"0:{run}:{g}".encode()).hexdigest())
        order = sorted(rows, key=lambda r: place(r[1]))
        a, b = [r[1] for r in sorted(order, key=lambda r: r[2])[:8]], [r[1] for r in sorted(order, key=lambda r: -r[3])[:8]]
        shared.append(len(set(a) & set(b)))
        best.append(b)
        top.append(set(a))
    assert (got.overlap_min, got.overlap_max) == (min(shared), max(shared)) and got.statistic_identical and all(b == best[0] for b in best)
    assert got.jaccard_min == pytest.approx(min(len(x & y) / len(x | y) for x, y in zip(top, top[1:])))


def test_rank_sum_against_all_ranks(spark):
    made = random.Random(5)
    cells = [(k, "T", k % 2) for k in range(60)]
    values = [(k, "g", float(made.choice([0.01, 0.5, 0.5, 1.0, 7.25, 300.0]))) for k in range(60) if made.random() < 0.6]
    obs, expr = spark.createDataFrame(cells, "cell_id long, celltype string, cond int"), spark.createDataFrame(values, "cell_id long, gene string, value double")
    have = dict((k, v) for k, _, v in values)
    x = [have.get(k, 0.0) for k in range(60)]
    rank = lambda v: sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2
    w = sum(rank(x[k]) for k in range(60) if k % 2)
    assert ranksum.rank_sum(expr, obs, condition.group_sizes(obs)).first().z == pytest.approx((w - 30 * 61 / 2) / (30 * 30 * 61 / 12) ** 0.5)
    tails = {r.z: (r.neglog10p, r.pvalue) for r in ranksum.two_sided(spark.createDataFrame([(0.0,), (1.959963984540054,), (60.0,), (None,)], "z double")).collect()}
    assert tails[0.0] == (pytest.approx(0, abs=1e-12), pytest.approx(1)) and tails[1.959963984540054][1] == pytest.approx(0.05) and tails[60.0][0] == pytest.approx(1800 / math.log(10) + math.log10(60 * math.sqrt(math.pi / 2)), abs=1e-3) and tails[None] == (None, None)


def test_comparison_run(spark, tmp_path):
    expr, obs, var = toy(spark)
    cells = obs.withColumn("cond", condition.by_label(F.col("condition"), "ctrl")).withColumn("donor", F.col("cell_id") % 12)
    counts = expr.withColumn("n", F.ceil("value").cast("double"))
    path = comparison.run_comparison(expr, counts, cells, var, str(tmp_path / "out"), k=5, settings=api.preset(api.Settings(assume_logged=True)))
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "| T | two_part |" in text and "| T | two_part | rank_sum |" in text and "| ALL | TOTAL_RUN |" in text
    calls = {r.method: r for r in spark.read.parquet(str(tmp_path / "out" / "calls.parquet")).collect()}
    assert set(calls) == set(comparison.METHODS) and calls["two_part"].n_significant >= 5
    pairs = spark.read.parquet(str(tmp_path / "out" / "concordance.parquet")).collect()
    assert {(r.method_a, r.method_b) for r in pairs} == {("two_part", "rank_sum"), ("two_part", "sample"), ("rank_sum", "sample")}
    listed = readers.inventory(spark, str(tmp_path / "out")).collect()
    assert any("calls.parquet" in r.path for r in listed) and all(r.rows is None and r.size_kb > 0 for r in listed)
    with pytest.raises(ValueError, match="two methods"):
        compare.pairwise(comparison.run_method("rank_sum", expr, counts, cells, var, api.Settings()), ["rank_sum"])
    with pytest.raises(ValueError, match="method must be one of"):
        comparison.run_method("other", expr, counts, cells, var, api.Settings())


def test_inventory_counts_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b c.csv").write_text("x\n")
    (tmp_path / "note.txt").write_text("one\n")
    (tmp_path / "skip.bin").write_text("one\n")
    got = {r.path.rsplit("/", 1)[1]: r.rows for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert got["a.csv"] == 2 and got["note.txt"] is None and "skip.bin" not in got and [v for k, v in got.items() if k.startswith("b")] == [0]


def test_timings(spark):
    clock = steps.Clock("p")
    with clock.stage("s"):
        pass
    rows = spark.createDataFrame([*[("a", f"s{k}", 1.0, 0.5, float(k)) for k in range(3)], ("b", "s", 2.0, 1.0, 9.0)], "process string, stage string, elapsed_s double, cpu_s double, peak_rss_mb double")
    got = {(r.process, r.stage): tuple(r)[2:] for r in steps.timings(rows).collect()}
    assert got[("a", "TOTAL_PROCESS")] == (3.0, 1.5, 2.0) and got[("ALL", "TOTAL_RUN")] == (5.0, 2.5, 9.0) and len(got) == 7
    assert clock.rows[0][:2] == ("p", "s") and clock.rows[0][4] > 0


def test_lookups_and_names(spark):
    df = spark.createDataFrame([("a", 1), ("b_N", 2), (None, 3)], "donor string, k int")
    names = spark.createDataFrame([("a", "P2"), ("a", "P1"), (None, "no")], "donor string, name string")
    got = prep.looked_up(df, "donor", names, "patient", F.regexp_replace("donor", "_N$", "")).orderBy("k").collect()
    assert [r.patient for r in got] == ["P1", "b", None]
    x = spark.createDataFrame([("HPAP-012_FGC34_5",), ("old HPAP012_5",), ("other",)], "name string").select(prep.library(F.col("name")).alias("l")).collect()
    assert [tuple(r.l) for r in x] == [("012", "FGC34", "5"), ("012", None, "5"), (None, None, None)]
    spec = spark.createDataFrame([("1-3,9, 11",), ("",), ("4",), ("5-4",)], "s string").select(columns.numbers(F.col("s")).alias("n")).collect()
    assert [r.n for r in spec] == [[1, 2, 3, 9, 11], [], [4], []]
    tail = spark.createDataFrame([(0.0,), (0.01,), (None,), (float("nan"),)], "p double").select(columns.neglog10_naive(F.col("p")).alias("x")).collect()
    assert [r.x for r in tail] == [323.0, 2.0, None, None]


def test_value_checks_find_what_is_wrong(spark):
    e = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 5.0)], "cell_id long, gene string, n double")
    good = prep.cp10k(e).drop("total")
    totals = spark.createDataFrame([(1, 4.0, 2), (2, 5.0, 1)], "cell_id long, total double, nnz long")
    count = lambda x, t: {r.rule: r.violations for r in prep.check_values(x, t).collect()}
    assert set(count(good, totals).values()) == {0}
    bad = count(good.withColumn("value", F.col("value") + (F.col("gene") == "b").cast("int")), totals.unionByName(spark.createDataFrame([(3, 1.0, 1)], totals.schema)).withColumn("nnz", F.lit(1)))
    assert bad == {"no_stored_zeros": 0, "values_of_counts": 1, "cells_with_counts": 0, "cell_sums": 1, "cell_nnz": 2}

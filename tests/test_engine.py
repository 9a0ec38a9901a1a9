import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tidemark.functions import special
from tidemark.operators import calibrate, calls, condition, design, general, hurdle, nb, prep, pseudobulk
from tidemark.operators.fdr import benjamini_hochberg
from tidemark.plans import api
from tidemark.schema import RESULT
from tidemark.sources import readers, writers


def toy(spark, cells=300, seed=0):
    """Genes 0-4 differ in detection, 5-9 in strength, the rest are null; gene all_zero, constant and separated beside."""
    random = np.random.default_rng(seed)
    cond = np.arange(cells) % 2
    rows = []
    for g in range(25):
        on = random.random(cells) < (np.where(cond == 1, 0.8, 0.2) if g < 5 else 0.5)
        v = random.lognormal(np.where(cond == 1, 1.6, 1.0) if 5 <= g < 10 else 1.0, 0.5, cells)
        rows += [(int(c), f"g{g:02d}", float(v[c])) for c in np.flatnonzero(on)]
    rows += [(int(c), "constant", 1.0) for c in range(0, cells, 3)]
    rows += [(int(c), "separated", float(random.lognormal(1, 0.5))) for c in range(cells) if cond[c] == 0 or random.random() < 0.6]
    obs = spark.createDataFrame([(int(c), "T", "stim" if cond[c] else "ctrl", int(c) % 6, float(random.normal())) for c in range(cells)], "cell_id long, celltype string, condition string, donor long, age double")
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    var = spark.createDataFrame([(f"g{g:02d}",) for g in range(25)] + [("all_zero",), ("constant",), ("separated",)], "gene string")
    return expr, obs, var


@pytest.fixture(scope="module")
def data(spark):
    return toy(spark)


@pytest.fixture(scope="module")
def result(spark, data):
    settings = api.Settings(covariates=(), assume_logged=True)
    return api.run_two_part(*data, "ctrl", "stim", settings=settings).toPandas().set_index("gene")


def test_contract(result):
    assert ["gene" if c == "gene" else c for c in RESULT.names if c != "gene"] == list(result.columns)
    t = result[result.tested]
    assert (t.fdr >= t.pvalue - 1e-12).all() and (t.neglog10p >= 0).all()
    assert result.loc["all_zero", "skip_reason"] == "all_zero" and result.loc["constant", "skip_reason"] == "singular_design"
    assert result.loc["separated", "detection_separated"] and set(result.ref_level) == {"ctrl"}


def test_power_and_nulls(result):
    called = result.fdr < 0.05
    assert called[[f"g{g:02d}" for g in range(10)]].sum() >= 9
    assert called[[f"g{g:02d}" for g in range(10, 25)]].sum() <= 1


def test_closed_form_agrees_with_fits(spark, data, result):
    expr, obs, var = data
    cells = obs.withColumn("cond", condition.by_label(F.col("condition"), "ctrl"))
    fits = general.fit_all(expr, cells, [], 10).toPandas().set_index("gene")
    for g in fits.index:
        if result.loc[g, "tested"]:
            assert abs(fits.loc[g, "stat_detect"] - result.loc[g, "stat_detect"]) < 1e-6 * max(1, result.loc[g, "stat_detect"])
            assert abs(fits.loc[g, "stat_continuous"] - result.loc[g, "stat_continuous"]) < 1e-6 * max(1, result.loc[g, "stat_continuous"])


def test_covariates_and_moderation(spark, data, result):
    settings = api.Settings(covariates=("cdr", "age", "unknown"), assume_logged=True)
    with_cov = api.run_two_part(*data, "ctrl", "stim", settings=settings).toPandas().set_index("gene")
    assert (with_cov.fdr < 0.05)[[f"g{g:02d}" for g in range(10)]].sum() >= 9
    eb = api.run_two_part(*data, "ctrl", "stim", settings=api.Settings(covariates=(), moderated=True, assume_logged=True)).toPandas().set_index("gene")
    t = eb[eb.tested]
    assert np.allclose(special.neglog10_chi2_sf(t.stat_hurdle, t.df_hurdle.astype(float)), t.neglog10p, rtol=1e-9)
    assert not np.allclose(t.stat_continuous, result.loc[t.index].stat_continuous)


def test_partial_preset_and_threshold(spark, data):
    expr, obs, var = data
    out = api.run_two_part(*data, "ctrl", "stim", mast_compat=True, settings=api.Settings(assume_logged=True)).toPandas().set_index("gene")
    assert out.loc["constant", "tested"] and out.loc["constant", "df_hurdle"] == 1
    thr = api.run_threshold(expr, obs, var, "age", 0.0, settings=api.Settings(covariates=(), assume_logged=True)).toPandas()
    assert set(thr.comparison) == {"high_vs_low_thr0.0"} and thr.tested.any()


def test_gates_and_empty_groups(spark, data):
    expr, obs, var = data
    none = api.run_two_part(expr, obs.where("condition = 'ctrl'"), var, "ctrl", "stim", settings=api.Settings(covariates=(), emit_skipped=True, assume_logged=True)).toPandas()
    assert set(none.skip_reason) == {"one_group_missing"} and len(none) == 28
    with pytest.raises(ValueError):
        condition.label_splits(obs, "condition", "nowhere")


def test_written_and_read_back(spark, data, result, tmp_path):
    for form in ("csv", "parquet"):
        path = api.run_two_part(*data, "ctrl", "stim", folder=str(tmp_path / form), form=form, settings=api.Settings(covariates=(), assume_logged=True))
        back = readers.read_result(spark, path).toPandas().set_index("gene")
        assert np.allclose(back.loc[result.index].stat_hurdle.astype(float), result.stat_hurdle.astype(float), equal_nan=True)
    diag = spark.read.option("header", True).csv(str(tmp_path / "csv" / "two_part_all_celltypes_diagnostics.csv")).toPandas()
    assert diag.status[0] == "ok" and int(diag.skip_all_zero[0]) == 1


def test_awkward_names_stay(spark, tmp_path):
    (tmp_path / "x.csv").write_text("gene,p\nNA,0.1\nNULL,NA\nMARCH1,\n")
    rows = readers.read_delimited(spark, str(tmp_path / "x.csv"), ["p"]).collect()
    assert [tuple(r) for r in rows] == [("NA", 0.1), ("NULL", None), ("MARCH1", None)]


def test_matrix_market_round_trip(spark, data, tmp_path):
    m = tmp_path / "m"
    m.mkdir()
    (m / "counts.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 3 3\n1 1 5\n2 3 1\n1 2 4\n")
    (m / "genes.txt").write_text("a\nb\n")
    (m / "cells.txt").write_text("x\ny\nz\n")
    got = {tuple(r) for r in readers.read_matrix_market(spark, str(m)).collect()}
    assert got == {("x", "a", 5.0), ("z", "b", 1.0), ("y", "a", 4.0)}
    writers.write_matrix_market(spark.createDataFrame(sorted(got), "cell_id string, gene string, n double").repartition(3), str(tmp_path / "out"))
    assert {tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "out"), "matrix", "genes", "cells").collect()} == got
    assert spark.read.text(str(tmp_path / "out" / "matrix")).count() == 5


def test_adjusted_p(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame([("t", f"g{i}", x) for i, x in enumerate(p)] + [("t", "g9", None)], "celltype string, gene string, p double")
    got = {r.gene: r.q for r in benjamini_hochberg(df, "p", "q", ["celltype"]).collect()}
    assert got["g9"] is None and np.allclose([got[f"g{i}"] for i in range(8)], nb.bh(np.array(p)))
    assert abs(got["g0"] - 0.008) < 1e-12 and abs(got["g2"] - 0.0672) < 1e-12


def test_verdicts(spark):
    a = spark.createDataFrame([("a", "t", 0.01, 1.0), ("b", "t", 0.01, -1.0), ("c", "t", 0.5, 1.0), ("d", "t", 0.01, 1.0), ("e", "t", 1e-9, 1.0)], "gene string, celltype string, fdr double, coef double")
    b = spark.createDataFrame([("a", "t", 0.01, 2.0, True), ("b", "t", 0.01, 2.0, True), ("c", "t", 0.01, 2.0, True), ("d", "t", 0.9, 2.0, True), ("e", "t", None, None, False)], "gene string, celltype string, pb_padj double, pb_log2FC double, pb_tested boolean")
    got = {r.gene: r.call for r in calls.combine_calls(a, b).collect()}
    assert got == {"a": "significant", "b": "direction_conflict", "c": "significant", "d": "ranked_only", "e": "not_tested"}


def test_sample_level(spark):
    random = np.random.default_rng(11)
    rows, obs = [], []
    for c in range(480):
        donor, stim = c % 8, int(c % 8 >= 4)
        obs.append((c, "T", stim, donor))
        for g in range(30):
            n = int(random.poisson(3 * (6 if stim and g < 4 else 1)))
            if n:
                rows.append((c, f"g{g:02d}", float(n)))
    obs = spark.createDataFrame(obs, "cell_id long, celltype string, cond int, donor long")
    counts, var = spark.createDataFrame(rows, "cell_id long, gene string, n double"), spark.createDataFrame([(f"g{g:02d}",) for g in range(31)], "gene string")
    out = pseudobulk.run_pseudobulk(counts, obs, var).toPandas().set_index("gene")
    assert (out.loc[[f"g{g:02d}" for g in range(4)], "pb_padj"] < 0.01).all() and out.loc["g30", "pb_skip_reason"] == "below_min_gene_counts"
    assert abs(out.loc["g00", "pb_log2FC"] - out.loc["g10", "pb_log2FC"] - np.log2(6)) < 0.3
    few = pseudobulk.run_pseudobulk(counts, obs.where("donor IN (0, 4)"), var).toPandas()
    assert few.pb_skip_reason.str.startswith("need>=2 donors/group (ref=").all()
    with pytest.raises(ValueError):
        pseudobulk.run_pseudobulk(counts, obs, var, paired=True)


def test_donor_splits():
    for n in (4, 5, 6, 7):
        s = calibrate.donor_splits(list(range(n)), 1000)
        assert len(s) == calibrate.n_donor_splits(n) == len({tuple(x) for x in s})
        assert all(sum(a for _, a in x) == len(x) // 2 for x in s)


def test_separated_logistic_fit():
    x = np.column_stack([np.ones(40), np.repeat([0.0, 1.0], 20)])
    y = np.column_stack([np.repeat([1.0, 0.0], 20), (np.arange(40) % 2).astype(float)])
    beta, llf = general.fit_logistic(x, y)
    assert np.isfinite(llf).all() and abs(llf[0]) < 1e-3 and np.abs(beta[1]).max() < 1e-8
    assert general.contingency(5, 10, 5, 10, "chisq")[0] == 0 and general.contingency(0, 10, 0, 10, "fisher")[2] == "constant"


def test_matrix_market_size_line_like_an_entry(tmp_path, spark):
    """A 2 x 2 matrix of two entries whose size line could be an entry, which also stands as one."""
    (tmp_path / "counts.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n2 2 2\n1 1 7\n2 2 2\n")
    (tmp_path / "genes.txt").write_text("b\na\n")
    (tmp_path / "cells.txt").write_text("x\ny\n")
    assert {tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path)).collect()} == {("x", "b", 7.0), ("y", "a", 2.0)}


def test_result_keeps_the_order_of_the_input(tmp_path, spark):
    var = spark.createDataFrame([("b", 0), ("c", 1), ("a", 2)], "gene string, gene_pos int")
    rows = spark.createDataFrame([("T", g) for g in "abc"] + [("S", g) for g in "cab"], "celltype string, gene string")
    path = writers.write_result(rows, str(tmp_path / "r.parquet"), var)
    files = sorted(f for f in (tmp_path / "r.parquet").iterdir() if f.suffix == ".parquet")
    got = [(r["celltype"], r["gene"]) for f in files for r in pq.read_table(f).to_pylist()]
    assert got == [(t, g) for t in "ST" for g in "bca"] and path.endswith("r.parquet")


def test_random_splits_are_different_and_equal(spark):
    for n, most, expected in ((4, 10, 3), (7, 6, 6), (25, 12, 12)):
        rows = calibrate.random_splits(spark.createDataFrame([(d,) for d in range(100, 100 + n)], "donor long"), most).collect()
        splits = {}
        for r in rows:
            splits.setdefault(r.split_id, {}).setdefault(r.arm, set()).add(r.donor)
        assert len(splits) == expected == len({frozenset(map(frozenset, s.values())) for s in splits.values()})
        assert all(len(s[0]) == len(s[1]) == n // 2 and min(s[0] | s[1]) in s[0] for s in splits.values())
    with pytest.raises(ValueError):
        calibrate.donor_splits(list(range(25)), 1000)


def test_fits_are_the_same_for_any_block_of_genes(spark, data, monkeypatch):
    expr, obs, _ = data
    cells = obs.withColumn("cond", condition.by_label(F.col("condition"), "ctrl"))
    values = expr.join(cells.select("cell_id", "celltype"), "cell_id").select("cell_id", "gene", "value").toPandas()
    values = values[values["value"] > 0]
    frame = cells.toPandas()
    whole = general.fit_genes("T", values, frame, ["age"], 10, False, "chisq")
    monkeypatch.setattr(general, "FITTED", 1)
    single = general.fit_genes("T", values.sample(frac=1, random_state=1), frame, ["age"], 10, False, "chisq")
    pd.testing.assert_frame_equal(whole, single, rtol=1e-9)
    assert (whole["df_detect"] + whole["df_continuous"]).max() == 2


def test_designs_fill_by_the_mean(spark):
    rows = [("T", 1, 1.0, "a"), ("T", 2, 3.0, "b"), ("T", 3, None, None), ("T", 4, 8.0, "b"), ("S", 5, 2.0, "b"), ("S", 6, 2.0, "c")]
    obs = spark.createDataFrame(rows, "celltype string, cell_id long, age double, site string")
    out, names = design.design(obs, ["age", "site", "nothing"])
    got = {r.cell_id: r.asDict() for r in out.collect()}
    x = np.array([1.0, 3.0, 4.0, 8.0])
    assert np.allclose([got[i]["z_age"] for i in (1, 2, 3, 4)], (x - x.mean()) / x.std()) and got[5]["z_age"] is None
    assert names == ["z_age", "site_a", "site_b", "site_c", "site_nan"] and out.columns[:4] == obs.columns
    # the first level of each cell type has no column of its own, and constant columns are null
    assert got[1]["site_a"] is None and got[5]["site_b"] is None and got[6]["site_c"] > 0 > got[5]["site_c"]
    with pytest.raises(ValueError):
        design.one_hot(obs, "site", most=2)


def test_permuted_numbers_do_not_depend_on_the_parts(spark):
    obs = spark.createDataFrame([(f"c{k:04d}", "T" if k % 3 else "U", k % 2) for k in range(700)], "cell_id string, celltype string, cond int")
    one = {r.cell_id: r.cond for r in calibrate.permuted(obs, cuts=1).collect()}
    assert one == {r.cell_id: r.cond for r in calibrate.permuted(obs, cuts=40).collect()} and len(one) == 700
    assert sum(one.values()) == 350 and any(one[f"c{k:04d}"] != k % 2 for k in range(700))


def test_split_statistics_are_those_of_each_split(spark, data):
    expr, obs, _ = data
    splits = calibrate.split_table(spark, calibrate.donor_splits(list(range(6)), 10))
    suff, sizes = calibrate.split_statistics(expr, obs, splits)
    cells = calibrate.swapped(obs, splits).where("split_id = 3")
    key = lambda df, *c: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    columns = ("gene", "c_ref", "c_test", "s_ref", "s_test", "q_ref", "q_test")
    assert key(suff.where("celltype = '3:T'"), *columns) == key(hurdle.sufficient(expr, cells), *columns)
    assert key(sizes.where("celltype = '3:T'"), "n_ref", "n_test", "n_cells") == key(condition.group_sizes(cells), "n_ref", "n_test", "n_cells")


def test_discoveries(spark):
    rows = [(0, "T", "a", 0.01), (0, "T", "b", 0.5), (0, "T", "c", None), (1, "T", "a", 0.9)]
    out = {r.split_id: r.asDict() for r in calibrate.discoveries(spark.createDataFrame(rows, "split_id int, celltype string, gene string, fdr double"), F.col("gene") == "a").collect()}
    assert out[0] == {"split_id": 0, "celltype": "T", "n_tested": 2, "n_tested_listed": 1, "n_discoveries": 1, "n_discoveries_listed": 1, "listed_discoveries": "a", "rejection_pct": 50.0, "any_discovery": True}
    assert out[1]["rejection_pct"] == 0.0 and not out[1]["any_discovery"] and out[1]["listed_discoveries"] == ""


def test_covariate_fits_hold_patterns_not_cells(spark, data, monkeypatch):
    """Cells alike are one row of a fit, whatever their number; fits in blocks of patterns are those of all cells at once."""
    expr, obs, _ = data
    expr = expr.where("gene IN ('g00', 'g03', 'g07', 'constant')")
    expr = expr.unionByName(expr.where("gene = 'g03' AND cell_id < 40"))  # a pair listed twice is detected once
    cells = obs.withColumns({"cond": condition.by_label(F.col("condition"), "ctrl"), "age": F.round("age", 1)})
    whole = general.fit_genes("T", expr.toPandas(), cells.toPandas(), ["age", "donor"], 10, False, "chisq").set_index("gene").sort_index()
    for size in (10**6, 60):
        monkeypatch.setattr(general, "PATTERNS", size)
        got = general.fit_all(expr, cells, ["age", "donor"], 10).toPandas().set_index("gene").sort_index()
        pd.testing.assert_frame_equal(got.astype({"dfres": "Int64"}), whole, rtol=1e-7, atol=1e-9, check_dtype=False)
    # twice the cells, the same patterns: the tables that tasks hold don't grow
    kept = {}
    monkeypatch.setattr(general, "PATTERNS", 10**6)
    monkeypatch.setattr(general, "keep", lambda df, label, write=general.keep: kept.setdefault(label, write(df, label)))
    few, sizes = cells.withColumn("age", F.round("age", 0)), []
    twice = lambda df: df.unionByName(df.withColumn("cell_id", F.col("cell_id") + 1000))
    for e, c in ((expr, few), (twice(expr), twice(few))):
        kept.clear()
        general.fit_all(e, c, ["age"], 10)
        sizes.append([kept[k].count() for k in ("cells", "patterns", "values")])
    assert sizes[1] == [600, *sizes[0][1:]] and sizes[0][1] < 20


def test_contract_rules_go_over_parts_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(prep, "ROWS", 100, raising=False)
    obs = [(c, c % 2, c % 8) for c in range(200)] + [(7, 1, 7), (201, 2, 9), (202, None, 9), (203, 1, 3), (204, 0, 3)]
    counts = [(c, f"g{g}", float(c % 5)) for c in range(200) for g in range(4)] + [(7, "g1", 1.0), (8, "g2", 2.0), (8, "g2", 2.0), (900, "g0", 1.5), (901, "g0", -1.0), (None, "g0", float("nan"))]
    obs, counts = spark.createDataFrame(obs, "cell_id long, cond int, donor long"), spark.createDataFrame(counts, "cell_id long, gene string, n double")
    out = prep.check_contract(obs, counts, unpaired=True)
    assert {r.rule: r.violations for r in out.collect()} == {"cell_id_unique": 1, "condition_known": 2, "counts_whole": 3, "pairs_unique": 2, "cells_known": 3, "donor_in_one_condition": 1}
    assert len(prep.check_contract(obs.drop("donor"), counts).collect()) == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    # 806 values in parts of 100: as many tasks for the rules on cells and pairs, which aren't joined again
    assert re.search(r"hashpartitioning\(cell_id#\d+L?, 9\), REPARTITION_BY_NUM", plan)

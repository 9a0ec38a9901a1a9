import datetime
import math
import os
import re
import subprocess
import sys

import duckdb
import pytest
from tidemark.plans import queries as q
from tidemark.plans import sample_queries  # noqa: F401  (registers its queries)

DATA = "/root/testdata/sf0.001"
FAST = ["group_sizes", "suff_stats", "gtest_detect", "gauss_lrt", "bh_fdr", "bh_masked", "pb_sums", "pb_welch", "combine_calls", "wilcoxon_z", "concordance", "roc_auc", "avg_precision", "ks_uniform", "fdr_matched", "icc_design_effect", "arm_offset", "donor_swap", "donor_swap_discoveries", "majority_label", "nb_params", "strict_skip_reasons", "streaming_windows", "missing_reasons", "claims", "order_sensitivity", "permutation_null", "stratified_sample", "consensus", "hurdle_full_statistics", "threshold_run_statistics", "words_by_quality_statistics", "events_by_user_statistics", "without_top_genes", "top_genes_in_order", "lookup_with_fallback", "sample_cell_counts", "first_and_all_labels", "gene_gate", "cells_with_counts", "value_checks", "donor_spread", "worst_genes", "aligned_to_genes", "order_overlap", "naive_tail_logit", "range_spec", "method_pairs", "hurdle_full", "eb_moderated", "threshold_run", "events_by_user", "bootstrap_ci", "glmm_detection", "bias_reduced_detection", "pb_size_factors", "library_factors"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "is_finite"):
        return v
    return None if math.isnan(float(v)) else float(f"{float(v):.10g}") + 0.0


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    cursor = duck.execute(q.SQL[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    expected = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in cursor.fetchall()), key=str)
    assert got == expected


def test_the_rest_stands_without_the_llm_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    subprocess.run(["cp", "-r", f"{root}/tidemark", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/tidemark/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""})
    assert re.match(r"\d+ False", out.stdout), out.stderr

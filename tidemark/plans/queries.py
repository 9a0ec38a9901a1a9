"""The query registry: each operator over the driver's tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, native
from ..operators import calibrate, calls, compare, condition, design, eb, general, hurdle, prep, pseudobulk, ranksum, scoring
from ..operators.fdr import benjamini_hochberg
from ..schema import average_rank
from ..sources.mappings import ORDERS_BY_PART_SQL, documents_by_word, orders_by_part, table, users_by_event
from . import api, tails_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# ---------------------------------------------------------------- common SQL


def xl(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 0 THEN 0.0 ELSE {a} * ln({b}) END)"


def sq(s: str, c: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN ({s}) * ({s}) / ({c}) ELSE 0.0 END)"


SIZES = """sizes AS (SELECT celltype, count(*) FILTER (cond = 0) AS n_ref, count(*) FILTER (cond = 1) AS n_test, count(*) AS n_cells FROM obs GROUP BY 1)"""
SUFF = """suff AS (SELECT celltype, gene, count(*) FILTER (cond = 0) AS c_ref, count(*) FILTER (cond = 1) AS c_test,
  coalesce(sum(value) FILTER (cond = 0), 0) AS s_ref, coalesce(sum(value) FILTER (cond = 1), 0) AS s_test,
  coalesce(sum(value * value) FILTER (cond = 0), 0) AS q_ref, coalesce(sum(value * value) FILTER (cond = 1), 0) AS q_test
  FROM expr JOIN obs USING (cell_id) WHERE value > 0 GROUP BY 1, 2)"""
DENSE = """dense AS (SELECT celltype, gene, n_ref, n_test, n_cells, coalesce(c_ref, 0) AS c_ref, coalesce(c_test, 0) AS c_test,
  coalesce(s_ref, 0) AS s_ref, coalesce(s_test, 0) AS s_test, coalesce(q_ref, 0) AS q_ref, coalesce(q_test, 0) AS q_test
  FROM sizes CROSS JOIN var LEFT JOIN suff USING (celltype, gene))"""


def _loglik(c: str, n: str) -> str:
    return xl(c, f"({c}) / ({n})::DOUBLE") + " + " + xl(f"(({n}) - ({c}))", f"(1 - ({c}) / ({n})::DOUBLE)")


N_POS, N_ALL = "(c_ref + c_test)", "(n_ref + n_test)"
STATS = f"""parts AS (SELECT *, {N_POS} AS n_positive,
  CASE WHEN {N_POS} > 0 AND {N_POS} < {N_ALL} AND n_ref > 0 AND n_test > 0 THEN 1 ELSE 0 END AS dd,
  greatest(0.0, q_ref + q_test - {sq('s_ref', 'c_ref')} - {sq('s_test', 'c_test')}) AS full0,
  greatest(0.0, q_ref + q_test - {sq('s_ref + s_test', N_POS)}) AS null0 FROM dense),
resid AS (SELECT *, CASE WHEN full0 > 1e-10 * (q_ref + q_test) THEN full0 ELSE 0.0 END AS rss_full FROM parts),
fits AS (SELECT *, CASE WHEN c_ref >= 1 AND c_test >= 1 AND n_positive >= {{least}} AND n_positive - 2 >= 1 AND rss_full > 0 THEN 1 ELSE 0 END AS dc FROM resid),
stats AS (SELECT *, CASE WHEN dd = 1 THEN greatest(0.0, 2 * ({_loglik('c_ref', 'n_ref')} + {_loglik('c_test', 'n_test')} - ({_loglik(N_POS, N_ALL)}))) ELSE 0.0 END AS sd,
  CASE WHEN dc = 1 THEN greatest(0.0, n_positive * ln(greatest(null0 / greatest(rss_full, 1e-12), 1.0))) ELSE 0.0 END AS sc FROM fits)"""
STRICT = """CASE WHEN n_positive = 0 THEN 'all_zero' WHEN n_positive < 10 THEN 'too_few_positive' WHEN c_ref = 0 OR c_test = 0 THEN 'no_positive_in_one_group' WHEN dc = 0 THEN 'singular_design' ELSE '' END"""
PARTIAL = """CASE WHEN n_positive = 0 THEN 'all_zero' WHEN dd + dc = 0 THEN 'model_failed' ELSE '' END"""
BASE = "WITH " + ORDERS_BY_PART_SQL + ", " + SIZES
WITH_SUFF = BASE + ", " + SUFF + ", " + DENSE


def with_stats(least: int) -> str:
    return WITH_SUFF + ", " + STATS.format(least=least)


#: p of the tested genes with both parts, an elementary tail; the calls and scores below rest on it.
PVALS = ", pvals AS (SELECT celltype, gene, n_ref, n_test, c_ref, c_test, s_ref, s_test, sd, sc, sd + sc AS stat, CASE WHEN dd + dc = 2 AND n_positive >= 10 THEN exp(-(sd + sc) / 2) END AS p, s_test / n_test - s_ref / n_ref AS coef FROM stats)"
BH_CTE = """, ranked AS (SELECT *, p * count(*) OVER (PARTITION BY celltype, p IS NULL) / row_number() OVER (PARTITION BY celltype, p IS NULL ORDER BY p, gene) AS ratio FROM pvals),
adj AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(ratio) OVER (PARTITION BY celltype, p IS NULL ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM ranked)"""
ADJUSTED = with_stats(10) + PVALS + BH_CTE


# ---------------------------------------------------------------- common frames

#: ``orders_by_part`` gives logarithms: no pass over the values to find out.
LOGGED = api.Settings(assume_logged=True)


def _stats(spark: SparkSession, sf: str, least: int = 10, partial: bool = False) -> DataFrame:
    m = orders_by_part(spark, sf)
    return hurdle.closed_form(m.expr, m.obs, m.var, condition.group_sizes(m.obs), least, partial)


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    m = orders_by_part(spark, sf)
    return hurdle.densify(hurdle.sufficient(m.expr, m.obs), condition.group_sizes(m.obs), m.var)


def _tested(dense: DataFrame) -> DataFrame:
    """celltype, gene, stat, p, q, coef with the elementary tail."""
    x = hurdle.continuous(hurdle.detection(hurdle.describe(dense)), 10)
    both = (F.col("df_detect") + F.col("df_continuous") == 2) & (F.col("n_positive") >= 10)
    x = x.withColumn("stat", F.col("stat_detect") + F.col("stat_continuous")).withColumn("p", F.when(both, F.exp(-F.col("stat") / 2))).withColumn("coef", F.col("mean_expr_test") - F.col("mean_expr_ref"))
    return benjamini_hochberg(x, "p", "q", ["celltype"])


def _adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return _tested(_dense(spark, sf))


# ---------------------------------------------------------------- conditions, gates, statistics


@query(BASE + ", hits AS (SELECT cell_id, count(*) FILTER (value > 0) AS k FROM expr GROUP BY 1) SELECT cell_id, round(coalesce(k, 0) / (SELECT count(*) FROM var)::DOUBLE, 6) AS cdr FROM obs LEFT JOIN hits USING (cell_id)")
def cdr_per_cell(spark, sf):
    m = orders_by_part(spark, sf)
    return condition.detection_rate(m.expr, m.obs, m.var.count()).select("cell_id", *r6("cdr"))


@query(BASE + " SELECT celltype, n_ref, n_test, n_cells FROM sizes")
def group_sizes(spark, sf):
    return condition.group_sizes(orders_by_part(spark, sf).obs)


@query(BASE + ", " + SUFF + " SELECT celltype, gene, c_ref, c_test, round(s_ref, 6) AS s_ref, round(s_test, 6) AS s_test, round(q_ref, 6) AS q_ref, round(q_test, 6) AS q_test FROM suff")
def suff_stats(spark, sf):
    m = orders_by_part(spark, sf)
    return hurdle.sufficient(m.expr, m.obs).select("celltype", "gene", "c_ref", "c_test", *r6("s_ref", "s_test", "q_ref", "q_test"))


@query(WITH_SUFF + " SELECT celltype, gene, round(c_ref / n_ref::DOUBLE, 6) AS detect_rate_ref, round(c_test / n_test::DOUBLE, 6) AS detect_rate_test, round(s_ref / n_ref, 6) AS mean_expr_ref, round(s_test / n_test, 6) AS mean_expr_test FROM dense")
def detect_rates_means(spark, sf):
    return hurdle.describe(_dense(spark, sf)).select("celltype", "gene", *r6("detect_rate_ref", "detect_rate_test", "mean_expr_ref", "mean_expr_test"))


_D = "(c_ref * (n_test - c_test) - c_test * (n_ref - c_ref))::DOUBLE"
_DEN = f"(n_ref::DOUBLE * n_test * {N_POS} * ({N_ALL} - {N_POS}))"


@query(WITH_SUFF + f" SELECT celltype, gene, c_ref AS pos_ref, n_ref - c_ref AS neg_ref, c_test AS pos_test, n_test - c_test AS neg_test, CASE WHEN {_DEN} > 0 THEN round({N_ALL} * {_D} * {_D} / {_DEN}, 6) END AS chi2 FROM dense")
def contingency_2x2(spark, sf):
    d = _dense(spark, sf)
    cr, ct, nr, nt = (F.col(k).cast("double") for k in ("c_ref", "c_test", "n_ref", "n_test"))
    diff, den = cr * (nt - ct) - ct * (nr - cr), nr * nt * (cr + ct) * (nr + nt - cr - ct)
    return d.select("celltype", "gene", F.col("c_ref").alias("pos_ref"), (F.col("n_ref") - F.col("c_ref")).alias("neg_ref"), F.col("c_test").alias("pos_test"), (F.col("n_test") - F.col("c_test")).alias("neg_test"), F.when(den > 0, F.round((nr + nt) * diff * diff / den, 6)).alias("chi2"))


@query(BASE + " SELECT cell_id, CASE WHEN regexp_matches(status, '(?i)f') THEN 0 ELSE 1 END AS cond FROM obs")
def condition_substring(spark, sf):
    return orders_by_part(spark, sf).obs.select("cell_id", condition.by_label(F.col("status"), "f").alias("cond"))


@query(BASE + " SELECT cell_id, CASE WHEN balance >= 5000 THEN 1 ELSE 0 END AS cond FROM obs")
def condition_threshold(spark, sf):
    return orders_by_part(spark, sf).obs.select("cell_id", condition.by_threshold(F.col("balance"), 5000).alias("cond"))


@query(BASE + " SELECT cell_id, CASE WHEN status = 'F' THEN 0 ELSE 1 END AS cond FROM obs WHERE status IN ('F', 'O')")
def condition_exact(spark, sf):
    return condition.by_exact(orders_by_part(spark, sf).obs, "status", "F", "O").select("cell_id", "cond")


@query(BASE + " SELECT celltype, CASE WHEN n_ref >= 200 AND n_test >= 200 AND n_cells >= 3000 THEN '' WHEN least(n_ref, n_test) = 0 THEN 'one_group_missing' ELSE 'too_few_cells' END AS gate_reason FROM sizes")
def celltype_gate(spark, sf):
    return condition.celltype_gate(condition.group_sizes(orders_by_part(spark, sf).obs), 200, 3000).select("celltype", "gate_reason")


@query(BASE + " SELECT celltype, gene, false AS tested, 'too_few_cells' AS skip_reason FROM sizes CROSS JOIN var WHERE NOT (n_ref >= 200 AND n_test >= 200 AND n_cells >= 3000)")
def emit_skipped(spark, sf):
    m = orders_by_part(spark, sf)
    gate = condition.celltype_gate(condition.group_sizes(m.obs), 200, 3000).where("gate_reason <> ''")
    return gate.crossJoin(m.var).select("celltype", "gene", F.lit(False).alias("tested"), F.col("gate_reason").alias("skip_reason"))


@query(BASE + " SELECT max(n) > 100 AS raw_is_unlogged, max(value) > 100 AS value_is_unlogged FROM expr")
def autolog_flag(spark, sf):
    return orders_by_part(spark, sf).expr.agg((F.max("n") > 100).alias("raw_is_unlogged"), (F.max("value") > 100).alias("value_is_unlogged"))


@query(with_stats(10) + f" SELECT celltype, gene, {STRICT} AS skip_reason FROM stats")
def strict_skip_reasons(spark, sf):
    return _stats(spark, sf).select("celltype", "gene", "skip_reason")


@query(with_stats(2) + f" SELECT celltype, gene, {PARTIAL} AS skip_reason FROM stats")
def partial_skip_reasons(spark, sf):
    return _stats(spark, sf, 2, True).select("celltype", "gene", "skip_reason")


@query(with_stats(10) + " SELECT celltype, gene, CAST(dd AS INTEGER) AS df_detect, round(sd, 6) AS stat_detect FROM stats")
def gtest_detect(spark, sf):
    return hurdle.detection(hurdle.describe(_dense(spark, sf))).select("celltype", "gene", "df_detect", *r6("stat_detect"))


@query(with_stats(10) + " SELECT celltype, gene, CAST(dc AS INTEGER) AS df_continuous, round(sc, 6) AS stat_continuous, CASE WHEN dc = 1 THEN round(s_test / c_test - s_ref / c_ref, 6) END AS beta, CASE WHEN dc = 1 THEN round(rss_full / (n_positive - 2), 6) END AS s2 FROM stats")
def gauss_lrt(spark, sf):
    return hurdle.continuous(_dense(spark, sf), 10).select("celltype", "gene", "df_continuous", *r6("stat_continuous", "beta", "s2"))


@query(with_stats(2) + f", t AS (SELECT *, {PARTIAL} AS why FROM stats) SELECT celltype, gene, CASE WHEN why = '' THEN round(sd + sc, 6) END AS stat_hurdle, CASE WHEN why = '' THEN CAST(dd + dc AS INTEGER) END AS df_hurdle FROM t")
def hurdle_partial(spark, sf):
    return _stats(spark, sf, 2, True).select("celltype", "gene", *r6("stat_hurdle"), "df_hurdle")


@query(ADJUSTED + " SELECT celltype, gene, CASE WHEN p IS NOT NULL THEN round(stat / (2 * ln(10)), 6) END AS neglog10p, round(p, 9) AS pvalue FROM adj")
def hurdle_neglog10p_df2(spark, sf):
    a = _adjusted(spark, sf)
    return a.select("celltype", "gene", F.when(F.col("p").isNotNull(), F.round(F.col("stat") / (2 * F.ln(F.lit(10.0))), 6)).alias("neglog10p"), F.round("p", 9).alias("pvalue"))


#: Moderated statistics of the continuous part, as ``why`` with another ``sc``.
MODERATED = f""", used AS (SELECT celltype, rss_full / (n_positive - 2) AS s2, (n_positive - 2) / 2.0 AS h FROM why0 WHERE skip = '' AND dc = 1),
excess AS (SELECT celltype, ln(s2) - {tails_sql.digamma('h')} + ln(h) AS e, {tails_sql.trigamma('h')} AS tri FROM used),
moments AS (SELECT celltype, avg(e) AS mean, var_samp(e) - avg(tri) AS v FROM excess GROUP BY 1 HAVING count(*) >= 10),
halved(celltype, mean, v, a, b, it) AS (SELECT celltype, mean, v, -ln(v), ln((1 + sqrt(1 + 4 * v)) / (2 * v)), 0 FROM moments WHERE v > 0
  UNION ALL SELECT celltype, mean, v, CASE WHEN tri > v THEN m ELSE a END, CASE WHEN tri > v THEN b ELSE m END, it + 1 FROM (SELECT *, {tails_sql.trigamma('exp(m)')} AS tri FROM (SELECT *, (a + b) / 2 AS m FROM halved WHERE it < 60))),
prior AS (SELECT celltype, least(2 * h, 1e6) AS d0, exp(mean + {tails_sql.digamma('h')} - ln(h)) AS s02 FROM (SELECT celltype, mean, exp((a + b) / 2) AS h FROM halved WHERE it = 60)
  UNION ALL SELECT celltype, 1e6, exp(mean) FROM moments WHERE NOT v > 0),
posted AS (SELECT why0.* EXCLUDE (sc), sc AS sc0, n_positive - 2 + d0 AS tdf, skip = '' AND dc = 1 AND d0 IS NOT NULL AS mod,
  abs(s_test / c_test - s_ref / c_ref) / sqrt(greatest((d0 * s02 + rss_full) / (d0 + n_positive - 2) * (1.0 / c_ref + 1.0 / c_test), 1e-300)) AS tz FROM why0 LEFT JOIN prior USING (celltype)),
logged AS (SELECT *, CASE WHEN mod THEN {tails_sql.t_log_two_sided('tz', 'tdf')} END AS tlp FROM posted),
why AS (SELECT *, CASE WHEN mod THEN {tails_sql.chi2_of_log_tail('tlp')} ELSE sc0 END AS sc FROM logged)"""


def _whole_sql(moderated: bool) -> str:
    """Every column of the result, rounded as ``_whole_rounded`` does."""
    head = with_stats(2).replace("WITH ", "WITH RECURSIVE ", 1) + f", why0 AS (SELECT *, {PARTIAL} AS skip FROM stats WHERE n_ref >= 1 AND n_test >= 1 AND n_cells >= 20)"
    head += MODERATED if moderated else ", why AS (SELECT * FROM why0)"
    logs = ", ".join(f"{tails_sql.chi2_log_tail(stat, df)} AS {name}" for name, stat, df in (("lh", "sd + sc", "(dd + dc)"), ("ld", "sd", "dd"), ("lc", "sc", "dc")))
    rank = "PARTITION BY celltype, lh IS NULL ORDER BY"
    head += f""", logs AS (SELECT *, {logs} FROM why), pv AS (SELECT * REPLACE (CASE WHEN skip = '' THEN lh END AS lh), CASE WHEN skip = '' THEN exp(lh) END AS p FROM logs),
ranks AS (SELECT *, p * count(*) OVER (PARTITION BY celltype, lh IS NULL) / row_number() OVER ({rank} p, gene) AS ratio FROM pv),
adj AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(ratio) OVER ({rank} p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM ranks)"""
    then = lambda x, d=6: f"CASE WHEN skip = '' THEN round({x}, {d}) END"
    count = lambda x: f"CASE WHEN skip = '' THEN CAST({x} AS INTEGER) END"
    columns = {
        "primerid": "gene", "gene": "gene", "coef": then("s_test / n_test - s_ref / n_ref"), "coef_continuous": f"CASE WHEN dc = 1 THEN {then('s_test / c_test - s_ref / c_ref')} END", '"Pr(>Chisq)"': "round(p, 5)", "pvalue": "round(p, 5)",
        "fdr": "round(q, 6)", "neglog10p": "round(-lh / ln(10), 6)", "p_detect": then("exp(ld)", 5), "p_continuous": then("exp(lc)", 5), "stat_detect": then("sd"), "stat_continuous": then("sc"), "stat_hurdle": then("sd + sc"),
        "df_detect": count("dd"), "df_continuous": count("dc"), "df_hurdle": count("dd + dc"), "n_cells": "n_cells", "n_ref": "n_ref", "n_test": "n_test", "n_positive": "n_positive", "n_positive_ref": "c_ref", "n_positive_test": "c_test",
        "detect_rate_ref": "round(c_ref / n_ref::DOUBLE, 6)", "detect_rate_test": "round(c_test / n_test::DOUBLE, 6)", "detection_separated": "c_ref = 0 OR c_ref = n_ref OR c_test = 0 OR c_test = n_test",
        "mean_expr_ref": "round(s_ref / n_ref, 6)", "mean_expr_test": "round(s_test / n_test, 6)", "celltype": "celltype", "comparison": "'ref_vs_test'", "ref_level": "'ref'", "test_level": "'test'", "lrt_term": "'conditiontest'",
        "tested": "skip = ''", "skip_reason": "skip", "method": "'two_part_hurdle'",
    }
    return head + " SELECT " + ", ".join(f"{c} AS {k}" for k, c in columns.items()) + " FROM adj"


def _whole_rounded(result: DataFrame) -> DataFrame:
    """p-values to five decimals (a statistic of 0 but for rounding has a p of nearly 1), other real numbers to six."""
    five = {"pvalue", "Pr(>Chisq)", "p_detect", "p_continuous"}
    return result.select(*[F.round(F.col(f"`{n}`"), 5 if n in five else 6).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in result.dtypes])


@query(_whole_sql(False))
def hurdle_full(spark, sf):
    """The whole result with all tails."""
    m = orders_by_part(spark, sf)
    return _whole_rounded(api.two_part(m.expr, m.obs, m.var, api.preset(LOGGED, moderated=False))[0])


@query(ADJUSTED + " SELECT celltype, gene, round(q, 6) AS fdr FROM adj")
def bh_fdr(spark, sf):
    return _adjusted(spark, sf).select("celltype", "gene", F.round("q", 6).alias("fdr"))


@query(with_stats(10) + PVALS + """, masked AS (SELECT celltype, gene, CASE WHEN gene NOT LIKE '%BRASS' THEN p END AS p FROM pvals),
ranked AS (SELECT *, p * count(*) OVER (PARTITION BY celltype, p IS NULL) / row_number() OVER (PARTITION BY celltype, p IS NULL ORDER BY p, gene) AS ratio FROM masked)
SELECT celltype, gene, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(ratio) OVER (PARTITION BY celltype, p IS NULL ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)), 6) END AS fdr FROM ranked""")
def bh_masked(spark, sf):
    a = _adjusted(spark, sf).drop("q")
    return benjamini_hochberg(a, "p", "fdr", ["celltype"], family=~F.col("gene").endswith("BRASS")).select("celltype", "gene", *r6("fdr"))


@query(WITH_SUFF + " SELECT celltype, gene, round(log2((exp(s_test / n_test) - 1 + 1e-9) / (exp(s_ref / n_ref) - 1 + 1e-9)), 5) AS coef FROM dense WHERE c_ref > 0 AND c_test > 0")
def coef_linear(spark, sf):
    d = hurdle.describe(_dense(spark, sf)).where("c_ref > 0 AND c_test > 0")
    return d.select("celltype", "gene", F.round(hurdle.linear_log2fc(F.col("mean_expr_test"), F.col("mean_expr_ref")), 5).alias("coef"))


@query(with_stats(10) + f" SELECT celltype, gene, CASE WHEN {STRICT} = '' THEN round(s_test / c_test - s_ref / c_ref, 6) END AS coef_continuous FROM stats")
def coef_continuous(spark, sf):
    return hurdle.coefficient(_stats(spark, sf), "continuous").select("celltype", "gene", *r6("coef_continuous"))


@query(WITH_SUFF + " SELECT celltype, gene, c_ref = 0 OR c_ref = n_ref OR c_test = 0 OR c_test = n_test AS detection_separated FROM dense")
def separated_flag(spark, sf):
    return hurdle.describe(_dense(spark, sf)).select("celltype", "gene", "detection_separated")


@query(with_stats(10) + f" SELECT celltype, gene, round(sd + sc, 6) AS stat_hurdle FROM stats WHERE {STRICT} = ''")
def drop_untested(spark, sf):
    return _stats(spark, sf).where("tested").select("celltype", "gene", *r6("stat_hurdle"))


@query(WITH_SUFF + " SELECT celltype, gene FROM dense WHERE greatest(c_ref / n_ref::DOUBLE, c_test / n_test::DOUBLE) >= 0.02")
def min_pct(spark, sf):
    return hurdle.describe(_dense(spark, sf)).where(F.greatest("detect_rate_ref", "detect_rate_test") >= 0.02).select("celltype", "gene")


@query(BASE + ", m AS (SELECT cell_id, balance, avg(balance) OVER (PARTITION BY celltype) AS a, stddev_pop(balance) OVER (PARTITION BY celltype) AS s FROM obs) SELECT cell_id, round((balance - a) / s, 6) AS z FROM m")
def zscore_covariate(spark, sf):
    obs = orders_by_part(spark, sf).obs.withColumn("z", F.col("balance"))
    return design.zscore(obs, ["z"]).select("cell_id", *r6("z"))


@query(BASE + ", l AS (SELECT *, min(status) OVER (PARTITION BY celltype) AS low FROM obs) SELECT cell_id, CASE WHEN status = low THEN 0.0 WHEN status = 'F' THEN 1.0 ELSE 0.0 END AS status_f, CASE WHEN status = low THEN 0.0 WHEN status = 'O' THEN 1.0 ELSE 0.0 END AS status_o, CASE WHEN status = low THEN 0.0 WHEN status = 'P' THEN 1.0 ELSE 0.0 END AS status_p FROM l")
def onehot_design(spark, sf):
    wide, names = design.one_hot(orders_by_part(spark, sf).obs, "status")
    have = {n: F.col(n) for n in names}
    return wide.select("cell_id", *[have.get(f"status_{k}", F.lit(0.0)).alias(f"status_{k.lower()}") for k in "FOP"])


# ---------------------------------------------------------------- sample level

META = """, nsam AS (SELECT celltype, donor, cond, count(*) AS n_cells FROM obs GROUP BY 1, 2, 3),
meta AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY celltype, donor) = 1 THEN donor::VARCHAR ELSE donor::VARCHAR || '|' || CASE WHEN cond = 0 THEN 'ref' ELSE 'test' END END AS sample FROM nsam),
good AS (SELECT * FROM meta WHERE n_cells >= {cells})"""
PB = """, pb AS (SELECT celltype, sample, donor, cond, gene, CAST(sum(n) AS BIGINT) AS n FROM expr JOIN obs USING (cell_id) JOIN good USING (celltype, donor, cond) GROUP BY 1, 2, 3, 4, 5)"""
WITH_PB = BASE + META.format(cells=10) + PB


@query(BASE + META.format(cells=10) + " SELECT celltype, sample, donor, cond, n_cells FROM good")
def pb_meta_names(spark, sf):
    return pseudobulk.samples(orders_by_part(spark, sf).obs).select("celltype", "sample", "donor", "cond", "n_cells")


@query(WITH_PB + " SELECT celltype, sample, gene, n FROM pb")
def pb_sums(spark, sf):
    m = orders_by_part(spark, sf)
    return pseudobulk.sums(m.expr, m.obs, pseudobulk.samples(m.obs)).select("celltype", "sample", "gene", "n")


@query(WITH_PB + ", keep AS (SELECT celltype, gene FROM pb GROUP BY 1, 2 HAVING sum(n) >= 2000) SELECT celltype, gene, CAST(sum(n) AS BIGINT) AS total FROM pb SEMI JOIN keep USING (celltype, gene) GROUP BY 1, 2")
def pb_gene_filter(spark, sf):
    m = orders_by_part(spark, sf)
    pb = pseudobulk.gene_filter(pseudobulk.sums(m.expr, m.obs, pseudobulk.samples(m.obs)), 2000)
    return pb.groupBy("celltype", "gene").agg(F.sum("n").alias("total"))


@query(BASE + META.format(cells=40) + ", g AS (SELECT celltype, count(*) FILTER (cond = 0) AS n_donors_ref, count(*) FILTER (cond = 1) AS n_donors_test FROM good GROUP BY 1) SELECT *, CASE WHEN least(n_donors_ref, n_donors_test) >= 20 THEN '' ELSE 'need>=20 donors/group (ref=' || n_donors_ref || ', test=' || n_donors_test || ')' END AS reason FROM g")
def pb_donor_gate(spark, sf):
    return pseudobulk.donor_gate(pseudobulk.samples(orders_by_part(spark, sf).obs, 40), 20)


@query(BASE + META.format(cells=10) + ", d AS (SELECT celltype, donor, count(DISTINCT cond) AS k FROM good GROUP BY 1, 2) SELECT celltype, CASE WHEN min(k) = 2 AND count(*) > 1 THEN 'paired' WHEN max(k) = 1 THEN 'unpaired' ELSE 'mixed' END AS design FROM d GROUP BY 1")
def pb_design_choice(spark, sf):
    return pseudobulk.design_choice(pseudobulk.samples(orders_by_part(spark, sf).obs))


PB_DENSE = WITH_PB + ", pbd AS (SELECT g.celltype, g.sample, g.cond, v.gene, coalesce(pb.n, 0) AS n FROM good g CROSS JOIN var v LEFT JOIN pb ON pb.celltype = g.celltype AND pb.sample = g.sample AND pb.gene = v.gene)"
WELCH = """, lib AS (SELECT *, log2((n + 0.5) / (sum(n) OVER (PARTITION BY celltype, sample) + 1.0) * 1e6) AS x FROM pbd),
wm AS (SELECT celltype, gene, avg(x) FILTER (cond = 0) AS m0, avg(x) FILTER (cond = 1) AS m1, var_samp(x) FILTER (cond = 0) AS v0, var_samp(x) FILTER (cond = 1) AS v1, count(*) FILTER (cond = 0) AS k0, count(*) FILTER (cond = 1) AS k1 FROM lib GROUP BY 1, 2),
welch AS (SELECT celltype, gene, m1 - m0 AS lfc, CASE WHEN v0 / k0 + v1 / k1 > 0 THEN (m1 - m0) / sqrt(v0 / k0 + v1 / k1) END AS t FROM wm)"""


def normal_sql(source: str, stat: str, name: str) -> str:
    """CTE ``name``: the rows of ``source`` with the two-sided normal tail of ``stat``: its logarithm lp, p, and q by Benjamini-Hochberg a cell type."""
    rank = "PARTITION BY celltype, p IS NULL ORDER BY"
    return f""", {name}_p AS (SELECT *, exp(lp) AS p FROM (SELECT *, CASE WHEN {stat} IS NOT NULL THEN least(0.0, {tails_sql.log_erfc(f'(abs({stat}) / sqrt(2.0))')}) END AS lp FROM {source})),
{name}_r AS (SELECT *, p * count(*) OVER (PARTITION BY celltype, p IS NULL) / row_number() OVER ({rank} p, gene) AS ratio FROM {name}_p),
{name} AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(ratio) OVER ({rank} p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM {name}_r)"""


def _normal(df: DataFrame, stat: str, p: str = "pvalue", q: str = "fdr") -> DataFrame:
    """neglog10p, ``p`` and ``q`` of a statistic that is normal without an effect."""
    log_p = F.when(F.col(stat).isNotNull(), F.least(F.lit(0.0), native.log_erfc(F.abs(stat) / math.sqrt(2.0))))
    out = df.withColumn("_lp", log_p).withColumn("neglog10p", native.neglog10(F.col("_lp"))).withColumn(p, F.exp("_lp")).drop("_lp")
    return benjamini_hochberg(out, p, q, ["celltype"])


def _welch(spark, sf):
    m = orders_by_part(spark, sf)
    return pseudobulk.welch(pseudobulk.sums(m.expr, m.obs, pseudobulk.samples(m.obs), m.var))


@query(PB_DENSE + WELCH + " SELECT celltype, gene, round(lfc, 6) AS pb_log2FC, round(t, 6) AS pb_stat FROM welch")
def pb_welch(spark, sf):
    return _welch(spark, sf).select("celltype", "gene", *r6("pb_log2FC", "pb_stat"))


@query(WITH_PB + ", keep AS (SELECT celltype, gene FROM pb GROUP BY 1, 2 HAVING sum(n) >= 2000), types AS (SELECT celltype, count(*) FILTER (cond = 0) AS a, count(*) FILTER (cond = 1) AS b FROM good GROUP BY 1) SELECT celltype, gene, CASE WHEN least(a, b) >= 2 THEN CASE WHEN celltype IN (SELECT celltype FROM keep) THEN 'below_min_gene_counts' ELSE 'no_genes_after_count_filter' END ELSE 'need>=2 donors/group (ref=' || a || ', test=' || b || ')' END AS pb_skip_reason FROM types CROSS JOIN var ANTI JOIN keep USING (celltype, gene)")
def pb_padding(spark, sf):
    m = orders_by_part(spark, sf)
    meta = pseudobulk.samples(m.obs)
    found = pseudobulk.gene_filter(pseudobulk.sums(m.expr, m.obs, meta), 2000).select("celltype", "gene").distinct().withColumn("pb_tested", F.lit(True)).withColumn("pb_skip_reason", F.lit(""))
    return pseudobulk.pad(found, pseudobulk.donor_gate(meta), m.var).where("NOT pb_tested").select("celltype", "gene", "pb_skip_reason")


@query(ADJUSTED.replace("WITH ", "WITH ", 1) + META.format(cells=10) + PB + ", pbd AS (SELECT g.celltype, g.sample, g.cond, v.gene, coalesce(pb.n, 0) AS n FROM good g CROSS JOIN var v LEFT JOIN pb ON pb.celltype = g.celltype AND pb.sample = g.sample AND pb.gene = v.gene)" + WELCH + normal_sql("welch", "t", "wq") + """,
arms AS (SELECT celltype, gene, adj.q AS q, coef, lfc, t IS NOT NULL AS pt, wq.q AS pq FROM adj FULL JOIN wq USING (celltype, gene))
SELECT celltype, gene, CASE WHEN NOT coalesce(pt, false) THEN 'not_tested' WHEN coalesce(pq < 0.3, false) THEN CASE WHEN coalesce(sign(lfc) = sign(coef), false) THEN 'significant' ELSE 'direction_conflict' END WHEN coalesce(q < 0.3, false) THEN 'ranked_only' ELSE 'ns' END AS call FROM arms""")
def combine_calls(spark, sf):
    """The cell-level test and Welch's statistic with normal tails, both adjusted, at a level of 0.3."""
    w = _normal(_welch(spark, sf).withColumn("pb_tested", F.col("pb_stat").isNotNull()), "pb_stat", "pb_pvalue", "pb_padj")
    a = _adjusted(spark, sf).select("celltype", "gene", "coef", F.col("q").alias("fdr"))
    return calls.combine_calls(a, w, 0.3).select("celltype", "gene", "call")


@query()
def nb_wald(spark, sf):
    m = orders_by_part(spark, sf)
    return pseudobulk.run_pseudobulk(m.expr, m.obs, m.var)


@query()
def nb_wald_paired_t(spark, sf):
    m = orders_by_part(spark, sf)
    both = m.obs.groupBy("celltype", "donor").agg(F.count_distinct("cond").alias("k")).where("k = 2").select("celltype", "donor")
    return pseudobulk.run_pseudobulk(m.expr, m.obs.join(both, ["celltype", "donor"], "left_semi"), m.var, paired=True, use_t=True, min_cells_per_donor=1)


@query()
def both_arms(spark, sf):
    m = orders_by_part(spark, sf)
    return api.run_both_arms(m.expr, m.expr, m.obs.where("status IN ('F', 'O')"), m.var, "F", "O", "donor", "status", settings=api.preset(LOGGED))


@query(_whole_sql(True))
def eb_moderated(spark, sf):
    """The whole result, variances moderated."""
    m = orders_by_part(spark, sf)
    return _whole_rounded(api.two_part(m.expr, m.obs, m.var, api.preset(LOGGED))[0])


@query()
def general_cdr(spark, sf):
    m = orders_by_part(spark, sf)
    return api.two_part(m.expr, m.obs, m.var, LOGGED)[0]


# The statistics of the four whole runs above, beside SQL: either part is enough, no moderation.

EVENTS_SQL = """
obs AS (SELECT DISTINCT user_id AS cell_id, 'all' AS celltype, CAST(user_id % 2 AS INTEGER) AS cond FROM events),
expr AS (SELECT user_id AS cell_id, event_type AS gene, count(*)::DOUBLE AS n, ln(1 + count(*)) AS value FROM events GROUP BY 1, 2),
var AS (SELECT DISTINCT event_type AS gene FROM events)
"""
WORDS_SQL = r"""
labelled AS (SELECT doc_id, lang, source, quality, text FROM documents JOIN labels USING (doc_id)),
obs AS (SELECT doc_id AS cell_id, lang AS celltype, quality AS cond FROM labelled),
words AS (SELECT doc_id AS cell_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS gene FROM labelled),
expr AS (SELECT cell_id, gene, count(*)::DOUBLE AS n, ln(1 + count(*)) AS value FROM words WHERE gene <> '' GROUP BY 1, 2),
var AS (SELECT DISTINCT gene FROM expr)
"""
BY_BALANCE_SQL = ORDERS_BY_PART_SQL.replace("CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END", "CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END")


@query(_whole_sql(True).replace(ORDERS_BY_PART_SQL, BY_BALANCE_SQL).replace("'ref_vs_test'", "'high_vs_low_thr5000'").replace("'ref'", "'low'").replace("'test'", "'high'").replace("'conditiontest'", "'conditionhigh'"))
def threshold_run(spark, sf):
    m = orders_by_part(spark, sf)
    return _whole_rounded(api.run_threshold(m.expr, m.obs.drop("cond"), m.var, "balance", 5000, settings=api.preset(LOGGED)))


@query(_whole_sql(False).replace(ORDERS_BY_PART_SQL, WORDS_SQL))
def words_by_quality(spark, sf):
    m = documents_by_word(spark, sf)
    return _whole_rounded(api.two_part(m.expr, m.obs, m.var, api.preset(api.Settings(), moderated=False))[0])


@query(_whole_sql(True).replace(ORDERS_BY_PART_SQL, EVENTS_SQL))
def events_by_user(spark, sf):
    m = users_by_event(spark, sf)
    return _whole_rounded(api.two_part(m.expr, m.obs, m.var, api.preset(api.Settings()))[0])


def _run_sql(inputs: str) -> str:
    """What ``_run_statistics`` gives, from the inputs as CTEs."""
    then = lambda x: f"CASE WHEN {PARTIAL} = '' THEN {x} END"
    return with_stats(2).replace(ORDERS_BY_PART_SQL, inputs) + f""" SELECT celltype, gene, n_ref, n_test, c_ref AS n_positive_ref, c_test AS n_positive_test, {PARTIAL} AS skip_reason, {then('round(sd, 6)')} AS stat_detect,
  {then('round(sc, 6)')} AS stat_continuous, {then('CAST(dd + dc AS INTEGER)')} AS df_hurdle, CASE WHEN {PARTIAL} = '' AND dd + dc = 2 THEN round((sd + sc) / (2 * ln(10)), 6) END AS neglog10p_df2 FROM stats WHERE n_cells >= 20"""


def _run_statistics(result: DataFrame) -> DataFrame:
    two = F.when(F.col("df_hurdle") == 2, F.round("neglog10p", 6)).alias("neglog10p_df2")
    return result.select("celltype", "gene", "n_ref", "n_test", "n_positive_ref", "n_positive_test", "skip_reason", *r6("stat_detect", "stat_continuous"), "df_hurdle", two)


def _plain_preset() -> api.Settings:
    return api.preset(LOGGED, moderated=False)


@query(_run_sql(ORDERS_BY_PART_SQL))
def hurdle_full_statistics(spark, sf):
    return _run_statistics(hurdle_full(spark, sf))


@query(_run_sql(BY_BALANCE_SQL))
def threshold_run_statistics(spark, sf):
    m = orders_by_part(spark, sf)
    return _run_statistics(api.run_threshold(m.expr, m.obs.drop("cond"), m.var, "balance", 5000, settings=_plain_preset()))


@query(_run_sql(WORDS_SQL))
def words_by_quality_statistics(spark, sf):
    return _run_statistics(words_by_quality(spark, sf))


@query(_run_sql(EVENTS_SQL))
def events_by_user_statistics(spark, sf):
    m = users_by_event(spark, sf)
    return _run_statistics(api.two_part(m.expr, m.obs, m.var, _plain_preset())[0])


# ---------------------------------------------------------------- ranks, concordance, truth

RANKS = BASE + """, pos AS (SELECT celltype, gene, cond, rank() OVER (PARTITION BY celltype, gene ORDER BY value) + (count(*) OVER (PARTITION BY celltype, gene, value) - 1) / 2.0 AS r FROM expr JOIN obs USING (cell_id) WHERE value > 0),
g AS (SELECT celltype, gene, count(*) AS nnz, count(*) FILTER (cond = 1) AS k, coalesce(sum(r) FILTER (cond = 1), 0) AS r FROM pos GROUP BY 1, 2),
z AS (SELECT celltype, gene, n_ref, n_test, r + k * (n_cells - nnz) + (n_test - k) * (n_cells - nnz + 1) / 2.0 AS w, n_cells FROM g JOIN sizes USING (celltype))"""


@query(RANKS + " SELECT celltype, gene, round((w - n_test * (n_cells + 1) / 2.0) / sqrt(n_test::DOUBLE * n_ref * (n_cells + 1) / 12.0), 6) AS z FROM z")
def wilcoxon_z(spark, sf):
    m = orders_by_part(spark, sf)
    return ranksum.rank_sum(m.expr, m.obs, condition.group_sizes(m.obs)).select("celltype", "gene", *r6("z"))


def _two_methods(spark, sf):
    """The cell-level and the sample-level statistic as two harmonised methods."""
    a = _adjusted(spark, sf).select("celltype", "gene", F.col("p").alias("pvalue"), F.col("q").alias("fdr"), F.col("coef").alias("log2fc"), F.when(F.col("p").isNotNull(), F.col("stat") / (2 * math.log(10))).alias("neglog10p"), "stat", F.col("p").isNotNull().alias("tested"), F.lit("").alias("skip_reason"))
    b = _normal(_welch(spark, sf), "pb_stat").select("celltype", "gene", "pvalue", "fdr", F.col("pb_log2FC").alias("log2fc"), "neglog10p", F.col("pb_stat").alias("stat"), F.col("pb_stat").isNotNull().alias("tested"), F.lit("").alias("skip_reason"))
    return compare.harmonise(a, "cell"), compare.harmonise(b, "sample")


TWO = ADJUSTED + META.format(cells=10) + PB + ", pbd AS (SELECT g.celltype, g.sample, g.cond, v.gene, coalesce(pb.n, 0) AS n FROM good g CROSS JOIN var v LEFT JOIN pb ON pb.celltype = g.celltype AND pb.sample = g.sample AND pb.gene = v.gene)" + WELCH + normal_sql("welch", "t", "wq") + """,
ma AS (SELECT celltype, gene, coef AS log2fc, CASE WHEN p IS NOT NULL THEN stat / (2 * ln(10)) END AS nlp, q AS fdr, p IS NOT NULL AS tested FROM adj),
mb AS (SELECT celltype, gene, lfc AS log2fc, -lp / ln(10) AS nlp, q AS fdr, t IS NOT NULL AS tested FROM wq)"""


@query(TWO + " SELECT celltype, gene, round(ma.log2fc, 6) AS log2fc_cell, round(mb.log2fc, 6) AS log2fc_sample FROM ma FULL JOIN mb USING (celltype, gene)")
def wide_outer(spark, sf):
    a, b = _two_methods(spark, sf)
    return compare.wide({"cell": a, "sample": b}, ["log2fc"]).select("celltype", "gene", *r6("log2fc_cell", "log2fc_sample"))


@query(TWO + " SELECT celltype, gene FROM ma JOIN mb USING (celltype, gene) WHERE ma.tested AND mb.tested")
def common_genes(spark, sf):
    a, b = _two_methods(spark, sf)
    return compare.common_genes(a.unionByName(b), 2)


@query(TWO + """, t1 AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY nlp DESC NULLS LAST, gene) <= 20 AS top FROM ma), t2 AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY nlp DESC NULLS LAST, gene) <= 20 AS top FROM mb),
j AS (SELECT celltype, gene, t1.log2fc AS x, t2.log2fc AS y, t1.nlp AS p, t2.nlp AS q, t1.fdr < 0.3 AS s, t2.fdr < 0.3 AS t, t1.top AND t2.top AS tt FROM t1 JOIN t2 USING (celltype, gene) WHERE t1.log2fc IS NOT NULL AND t2.log2fc IS NOT NULL AND t1.nlp IS NOT NULL AND t2.nlp IS NOT NULL),
r AS (SELECT *, """ + ", ".join(f"rank() OVER (PARTITION BY celltype ORDER BY {c}) + (count(*) OVER (PARTITION BY celltype, {c}) - 1) / 2.0 AS r{c}" for c in "xypq") + """ FROM j)
SELECT celltype, count(*) AS n_genes, round(corr(x, y), 6) AS pearson_log2fc, round(corr(rx, ry), 6) AS spearman_log2fc, round(corr(rp, rq), 6) AS spearman_neglog10p, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement,
round(count(*) FILTER (s AND t) / nullif(count(*) FILTER (s OR t), 0)::DOUBLE, 6) AS jaccard, count(*) FILTER (tt) AS topk_overlap FROM r GROUP BY 1""")
def concordance(spark, sf):
    a, b = _two_methods(spark, sf)
    c = compare.concordance(a, b, alpha=0.3)
    return c.select("celltype", "n_genes", *r6("pearson_log2fc", "spearman_log2fc", "spearman_neglog10p", "sign_agreement", "jaccard"), "topk_overlap")


@query(TWO + """, u AS (SELECT 'cell' AS method, * FROM ma UNION ALL SELECT 'sample', * FROM mb)
SELECT celltype, gene, count(*) FILTER (tested) AS n_methods_tested, count(*) FILTER (coalesce(fdr < 0.3, false)) AS n_methods_sig, coalesce(string_agg(method, ',' ORDER BY method) FILTER (coalesce(fdr < 0.3, false)), '') AS methods_sig, count(DISTINCT sign(log2fc)) FILTER (coalesce(fdr < 0.3, false)) <= 1 AS same_direction FROM u GROUP BY 1, 2""")
def consensus(spark, sf):
    a, b = _two_methods(spark, sf)
    return compare.consensus(a.unionByName(b), 0.3)


@query(TWO + " SELECT celltype, gene, coalesce(ma.fdr < 0.3, false) AS sig_a, coalesce(mb.fdr < 0.3, false) AS sig_b, CASE WHEN coalesce(ma.fdr < 0.3, false) THEN 'a' ELSE 'b' END AS only_in FROM ma FULL JOIN mb USING (celltype, gene) WHERE coalesce(ma.fdr < 0.3, false) <> coalesce(mb.fdr < 0.3, false)")
def symdiff_calls(spark, sf):
    a, b = _two_methods(spark, sf)
    return compare.changed_calls(a, b, 0.3)


@query(with_stats(10) + f" SELECT celltype, gene, {STRICT} AS skip_reason FROM stats WHERE {STRICT} <> '' UNION ALL SELECT celltype, gene || '*', 'absent' FROM stats")
def missing_reasons(spark, sf):
    """Of the genes tested and as many that the run has no row of."""
    s = _stats(spark, sf)
    asked = s.select("celltype", "gene")
    return compare.missing_with_reason(asked.unionByName(asked.select("celltype", F.concat("gene", F.lit("*")).alias("gene"))), s).select("celltype", "gene", "skip_reason")


@query(ADJUSTED + ", t AS (SELECT celltype, gene, CAST(row_number() OVER (PARTITION BY celltype ORDER BY p, gene) AS INTEGER) AS rank FROM adj WHERE p IS NOT NULL) SELECT * FROM t WHERE rank <= 10")
def topk_stable(spark, sf):
    w = Window.partitionBy("celltype").orderBy("p", "gene")
    return _adjusted(spark, sf).where("p IS NOT NULL").select("celltype", "gene", F.row_number().over(w).alias("rank")).where("rank <= 10")


@query(BASE + " SELECT celltype, least(n_ref, n_test) AS balance FROM sizes WHERE least(n_ref, n_test) >= 10 ORDER BY 2 DESC, 1 LIMIT 3")
def pick_celltypes(spark, sf):
    return prep.balanced_celltypes(condition.group_sizes(orders_by_part(spark, sf).obs), 3).select("celltype", "balance")


@query(BASE + " SELECT gene, sum(n) AS total FROM expr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def topn_genes(spark, sf):
    return prep.top_genes(orders_by_part(spark, sf).expr, 50)


@query(BASE + ", k AS (SELECT gene FROM expr WHERE value > 0 GROUP BY 1 HAVING count(*) >= 400) SELECT gene, count(*) AS cells FROM expr SEMI JOIN k USING (gene) GROUP BY 1")
def expressed_in(spark, sf):
    return prep.expressed_in(orders_by_part(spark, sf).expr, 400).groupBy("gene").agg(F.count("*").alias("cells"))


TRUTH = ADJUSTED + ", truth AS (SELECT *, substr(md5(gene), 1, 1) < '5' AS is_alt FROM adj WHERE p IS NOT NULL)"


def _truth(spark, sf):
    return _adjusted(spark, sf).where("p IS NOT NULL").withColumn("is_alt", F.substring(F.md5("gene"), 1, 1) < "5")


@query(TRUTH + ", c AS (SELECT celltype, count(*) FILTER (p < 0.3 AND is_alt) AS tp, count(*) FILTER (p < 0.3 AND NOT is_alt) AS fp, count(*) FILTER (p >= 0.3 AND is_alt) AS fn, count(*) FILTER (p >= 0.3 AND NOT is_alt) AS tn FROM truth GROUP BY 1) SELECT *, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS sensitivity, round(fp / greatest(tp + fp, 1)::DOUBLE, 6) AS observed_fdr FROM c")
def confusion(spark, sf):
    c = scoring.confusion(_truth(spark, sf), F.col("p") < 0.3, F.col("is_alt"), ["celltype"])
    return c.select("celltype", "tp", "fp", "fn", "tn", *r6("sensitivity", "observed_fdr"))


_ROUNDED = TRUTH + ", t AS (SELECT celltype, gene, is_alt, round(stat, 3) AS s FROM truth)"


def _rounded(spark, sf):
    return _truth(spark, sf).withColumn("s", F.round("stat", 3))


CURVE = ", g AS (SELECT celltype, s, count(*) FILTER (is_alt) AS p, count(*) FILTER (NOT is_alt) AS n FROM t GROUP BY 1, 2), curve AS (SELECT celltype, s, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM g WINDOW w AS (PARTITION BY celltype ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"


@query(_ROUNDED + CURVE + " SELECT * FROM curve")
def roc_curve(spark, sf):
    return scoring.roc_curve(_rounded(spark, sf), "s", "is_alt", ["celltype"])


@query(_ROUNDED + ", r AS (SELECT *, rank() OVER (PARTITION BY celltype ORDER BY s) + (count(*) OVER (PARTITION BY celltype, s) - 1) / 2.0 AS r FROM t), a AS (SELECT celltype, sum(r) FILTER (is_alt) AS x, count(*) FILTER (is_alt) AS n1, count(*) FILTER (NOT is_alt) AS n0 FROM r GROUP BY 1) SELECT celltype, n1, n0, round((x - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM a")
def roc_auc(spark, sf):
    return scoring.roc_auc(_rounded(spark, sf), "s", "is_alt", ["celltype"]).select("celltype", "n1", "n0", *r6("auc"))


@query(_ROUNDED + CURVE + ", st AS (SELECT *, tp - coalesce(lag(tp) OVER (PARTITION BY celltype ORDER BY s DESC), 0) AS d, max(tp) OVER (PARTITION BY celltype) AS m FROM curve) SELECT celltype, round(sum(d / m::DOUBLE * tp / (tp + fp)), 6) AS average_precision FROM st GROUP BY 1")
def avg_precision(spark, sf):
    return scoring.average_precision(_rounded(spark, sf), "s", "is_alt", ["celltype"]).select("celltype", *r6("average_precision"))


@query(TRUTH + ", r AS (SELECT celltype, p, row_number() OVER (PARTITION BY celltype ORDER BY p) AS i, count(*) OVER (PARTITION BY celltype) AS n FROM truth) SELECT celltype, round(max(greatest(i / n::DOUBLE - p, p - (i - 1) / n::DOUBLE)), 6) AS ks, count(*) AS n FROM r GROUP BY 1")
def ks_uniform(spark, sf):
    return scoring.ks_uniform(_truth(spark, sf), "p", ["celltype"]).select("celltype", *r6("ks"), "n")


@query(TRUTH + " SELECT celltype, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rejected, round(median(p), 6) AS median_p, count(*) AS n FROM truth GROUP BY 1")
def type1_summary(spark, sf):
    return scoring.type_one(_truth(spark, sf), "p", ["celltype"]).select("celltype", *r6("rejected", "median_p"), "n")


@query(_ROUNDED + """, cal AS (SELECT * FROM t WHERE celltype IN ('BUILDING', 'MACHINERY')),
grid AS (SELECT DISTINCT unnest(quantile_cont(s, [""" + ", ".join(str(k / 799) for k in range(800)) + """])) AS th FROM cal),
f AS (SELECT th, celltype, count(*) FILTER (s >= th AND NOT is_alt) / greatest(count(*) FILTER (s >= th), 1)::DOUBLE AS fdr FROM grid CROSS JOIN cal GROUP BY 1, 2),
m AS (SELECT th, avg(fdr) AS fdr FROM f GROUP BY 1) SELECT round(min(th), 4) AS threshold FROM m WHERE fdr <= 0.6""")
def fdr_matched(spark, sf):
    return scoring.fdr_matched(_rounded(spark, sf), "s", "is_alt", "celltype", ["BUILDING", "MACHINERY"], level=0.6).select(F.round("threshold", 4).alias("threshold"))


ICC = BASE + """, nd AS (SELECT celltype, donor, count(*) AS n FROM obs GROUP BY 1, 2), tot AS (SELECT celltype, sum(n) AS cells, count(*) AS donors, sum(n * n) AS n2 FROM nd GROUP BY 1),
x AS (SELECT celltype, donor, gene, sum(value) AS s, sum(value * value) AS q FROM expr JOIN obs USING (cell_id) GROUP BY 1, 2, 3),
g AS (SELECT celltype, gene, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM x JOIN nd USING (celltype, donor) GROUP BY 1, 2),
ms AS (SELECT celltype, gene, (b - s * s / cells) / (donors - 1) AS mb, (q - b) / (cells - donors) AS mw, (cells - n2 / cells::DOUBLE) / (donors - 1) AS n0 FROM g JOIN tot USING (celltype)),
v AS (SELECT *, greatest(0.0, (mb - mw) / n0) AS vb FROM ms), icc AS (SELECT *, vb / (vb + mw) AS icc FROM v)"""


@query(ICC + " SELECT celltype, gene, round(mb, 6) AS ms_between, round(mw, 6) AS ms_within, round(icc, 6) AS icc, round(1 + (n0 - 1) * icc, 5) AS design_effect FROM icc")
def icc_design_effect(spark, sf):
    m = orders_by_part(spark, sf)
    return calibrate.design_effect(m.expr, m.obs).select("celltype", "gene", *r6("ms_between", "ms_within", "icc"), F.round("design_effect", 5).alias("design_effect"))


@query(BASE + """, cv AS (SELECT o.celltype, o.donor, o.cond, coalesce(e.v, 0) AS v FROM obs o LEFT JOIN (SELECT cell_id, sum(value) AS v FROM expr GROUP BY 1) e USING (cell_id)),
dm AS (SELECT celltype, donor, cond, avg(v) AS v FROM cv GROUP BY 1, 2, 3), """ + ", ".join(f"{n} AS (SELECT celltype, avg(v) FILTER (cond = 0) AS m0, avg(v) FILTER (cond = 1) AS m1, var_samp(v) FILTER (cond = 0) AS v0, var_samp(v) FILTER (cond = 1) AS v1, count(*) FILTER (cond = 0) AS n0, count(*) FILTER (cond = 1) AS n1 FROM {t} GROUP BY 1)" for n, t in (("a", "dm"), ("c", "cv"))) + """
SELECT celltype, round((a.m1 - a.m0) / (sqrt(((a.n0 - 1) * a.v0 + (a.n1 - 1) * a.v1) / (a.n0 + a.n1 - 2)) * sqrt(1.0 / a.n0 + 1.0 / a.n1)), 6) AS donor_t, round((c.m1 - c.m0) / sqrt(((c.n0 - 1) * c.v0 + (c.n1 - 1) * c.v1) / (c.n0 + c.n1 - 2)), 6) AS cell_d FROM a JOIN c USING (celltype)""")
def arm_offset(spark, sf):
    m = orders_by_part(spark, sf)
    return calibrate.arm_offset(m.expr, m.obs).select("celltype", *r6("donor_t", "cell_d"))


@query(ICC + ", e AS (SELECT celltype, gene, round(icc, 6) AS i FROM icc), r AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY i, gene) AS r, count(*) OVER (PARTITION BY celltype) AS n FROM e) SELECT celltype, gene, CAST(greatest(1, ceil(4.0 * (r - 1) / (n - 1))) AS INTEGER) AS quartile FROM r")
def design_quartile_fp(spark, sf):
    m = orders_by_part(spark, sf)
    e = calibrate.design_effect(m.expr, m.obs).select("celltype", "gene", F.round("icc", 6).alias("i"))
    return e.select("celltype", "gene", scoring.quartile("i", ["celltype"]).alias("quartile"))


SPLITS = """, donors AS (SELECT donor FROM obs GROUP BY 1 HAVING count(*) >= 10),
draws AS (SELECT k AS split_id, donor, row_number() OVER (PARTITION BY k ORDER BY md5('0:' || k || ':' || donor), donor) AS r, count(*) OVER (PARTITION BY k) // 2 AS half FROM donors, range(40) t(k)),
arms AS (SELECT split_id, donor, CAST(r > half AS INTEGER) AS arm FROM draws WHERE r <= 2 * half),
dealt AS (SELECT split_id, donor, abs(arm - arg_min(arm, donor) OVER (PARTITION BY split_id)) AS arm FROM arms),
drawn AS (SELECT split_id, string_agg(donor || ':' || arm, ',' ORDER BY donor) AS same FROM dealt GROUP BY 1),
firsts AS (SELECT min(split_id) AS split_id FROM drawn GROUP BY same ORDER BY 1 LIMIT 10),
splits AS (SELECT dealt.* FROM dealt SEMI JOIN firsts USING (split_id))"""


@query(BASE + SPLITS + " SELECT CAST(split_id AS INTEGER) AS split_id, celltype, count(*) FILTER (arm = 0) AS n_ref, count(*) FILTER (arm = 1) AS n_test FROM obs JOIN splits USING (donor) GROUP BY 1, 2")
def donor_swap(spark, sf):
    """Cells of each arm in ten drawn splits of all donors."""
    obs = orders_by_part(spark, sf).obs
    x = calibrate.swapped(obs, calibrate.random_splits(calibrate.eligible_donors(obs), 10))
    return x.groupBy("split_id", "celltype").agg(F.count_if(F.col("cond") == 0).alias("n_ref"), F.count_if(F.col("cond") == 1).alias("n_test"))


SPLIT_SQL = "WITH " + ORDERS_BY_PART_SQL + SPLITS + ", scoped AS (SELECT split_id || ':' || celltype AS celltype, cell_id, arm AS cond FROM obs JOIN splits USING (donor)), " + (SIZES + ", " + SUFF).replace("obs", "scoped") + ", " + DENSE + ", " + STATS.format(least=10) + PVALS + BH_CTE


@query(SPLIT_SQL + """ SELECT CAST(split_part(celltype, ':', 1) AS INTEGER) AS split_id, split_part(celltype, ':', 2) AS celltype, count(q) AS n_tested, count(q) FILTER (gene LIKE 'Brand#1%') AS n_tested_listed, count(*) FILTER (q < 0.6) AS n_discoveries,
  count(*) FILTER (q < 0.6 AND gene LIKE 'Brand#1%') AS n_discoveries_listed, coalesce(string_agg(gene, ';' ORDER BY gene) FILTER (q < 0.6 AND gene LIKE 'Brand#1%'), '') AS listed_discoveries,
  round(100.0 * count(*) FILTER (q < 0.6) / greatest(count(q), 1), 6) AS rejection_pct, count(*) FILTER (q < 0.6) > 0 AS any_discovery FROM adj GROUP BY 1, 2""")
def donor_swap_discoveries(spark, sf):
    """What the cell-level test finds between arms that no condition tells apart, in ten drawn splits; brands of one kind are the list."""
    m = orders_by_part(spark, sf)
    suff, sizes = calibrate.split_statistics(m.expr, m.obs, calibrate.random_splits(calibrate.eligible_donors(m.obs), 10))
    a = _tested(hurdle.densify(suff, sizes, m.var)).select(F.split("celltype", ":")[0].cast("int").alias("split_id"), F.split("celltype", ":")[1].alias("celltype"), "gene", F.col("q").alias("fdr"))
    return calibrate.discoveries(a, F.col("gene").startswith("Brand#1"), 0.6).withColumn("rejection_pct", F.round("rejection_pct", 6))


@query(BASE + ", r AS (SELECT celltype, cond, cell_id, row_number() OVER (PARTITION BY celltype, cond ORDER BY md5('0:' || cell_id), cell_id) AS r FROM obs) SELECT celltype, cond, cell_id FROM r WHERE r <= 50")
def stratified_sample(spark, sf):
    return calibrate.stratified(orders_by_part(spark, sf).obs, ["celltype", "cond"], 50).select("celltype", "cond", "cell_id")


@query(BASE + ", a AS (SELECT cell_id, celltype, row_number() OVER (PARTITION BY celltype ORDER BY md5('0:' || cell_id), cell_id) AS k FROM obs), b AS (SELECT celltype, cond, row_number() OVER (PARTITION BY celltype ORDER BY cell_id) AS k FROM obs) SELECT cell_id, b.cond FROM a JOIN b USING (celltype, k)")
def permutation_null(spark, sf):
    return calibrate.permuted(orders_by_part(spark, sf).obs).select("cell_id", "cond")


@query(BASE + ", r AS (SELECT celltype, donor, round(avg(balance), 2) AS b FROM obs GROUP BY 1, 2) SELECT celltype, CAST(count(*) AS BIGINT) AS n, round(avg(b), 4) AS mean, round(stddev_samp(b), 4) AS sd, min(b) AS low, max(b) AS high, round(median(b), 4) AS median, round(quantile_cont(b, 0.25), 4) AS q1 FROM r GROUP BY 1")
def replicate_summary(spark, sf):
    r = orders_by_part(spark, sf).obs.groupBy("celltype", "donor").agg(F.round(F.avg("balance"), 2).alias("b"))
    return r.groupBy("celltype").agg(F.count("*").alias("n"), F.round(F.avg("b"), 4).alias("mean"), F.round(F.stddev_samp("b"), 4).alias("sd"), F.min("b").alias("low"), F.max("b").alias("high"), F.round(F.median("b"), 4).alias("median"), F.round(F.percentile("b", 0.25), 4).alias("q1"))


@query(BASE + """, v AS (SELECT celltype, donor, avg(balance) AS b FROM obs GROUP BY 1, 2), numbered AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY celltype) AS n FROM v),
drawn AS (SELECT celltype, k, CAST('0x' || substr(md5('0:' || k || ':' || j), 1, 12) AS BIGINT) % n AS i FROM (SELECT DISTINCT celltype, n FROM numbered), unnest(range(1, 2001)) AS a(k), unnest(range(0, n)) AS c(j)),
m AS (SELECT celltype, k, avg(b) AS m FROM drawn JOIN numbered USING (celltype, i) GROUP BY 1, 2), e AS (SELECT celltype, avg(b) AS mean FROM v GROUP BY 1)
SELECT celltype, round(any_value(e.mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN e USING (celltype) GROUP BY 1""")
def bootstrap_ci(spark, sf):
    r = orders_by_part(spark, sf).obs.groupBy("celltype", "donor").agg(F.avg("balance").alias("b"))
    return calibrate.bootstrap_mean(r, "b", ["celltype"]).select("celltype", *r6("mean", "low", "high"))


# ---------------------------------------------------------------- preparation


@query(BASE + " SELECT cell_id, gene, round(ln(1 + n * 1e4 / sum(n) OVER (PARTITION BY cell_id)), 6) AS value FROM expr")
def cp10k(spark, sf):
    return prep.cp10k(orders_by_part(spark, sf).expr).select("cell_id", "gene", *r6("value"))


@query(BASE + " SELECT cell_id, gene, CAST(n AS BIGINT) AS recovered FROM expr")
def recover_counts(spark, sf):
    return prep.recover_counts(prep.cp10k(orders_by_part(spark, sf).expr)).select("cell_id", "gene", "recovered")


@query(BASE + " SELECT donor, cell_id % 97 AS barcode, gene, sum(n) AS n FROM expr JOIN obs USING (cell_id) GROUP BY 1, 2, 3")
def merge_runs(spark, sf):
    m = orders_by_part(spark, sf)
    x = m.expr.join(m.obs.select("cell_id", "donor"), "cell_id").withColumn("barcode", F.col("cell_id") % 97)
    return prep.merge_runs(x, ["donor", "barcode"])


@query(BASE + """, g AS (SELECT donor, status, count(*) AS n, max(balance) AS heaviest FROM obs GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY donor ORDER BY n DESC, heaviest DESC, status) AS r, n / sum(n) OVER (PARTITION BY donor)::DOUBLE AS agreement, string_agg(status, ',') OVER (PARTITION BY donor ORDER BY status ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS labels FROM g)
SELECT donor, status AS label, round(agreement, 6) AS agreement, labels FROM r WHERE r = 1""")
def majority_label(spark, sf):
    return prep.majority_label(orders_by_part(spark, sf).obs, ["donor"], "status", "balance").select("donor", "label", *r6("agreement"), "labels")


@query(BASE + ", c AS (SELECT DISTINCT donor, cell_id // 4 AS barcode, 'run' || (cell_id % 4) AS run FROM obs) SELECT a.donor, a.run AS run_a, b.run AS run_b, count(*) AS shared FROM c a JOIN c b ON a.donor = b.donor AND a.barcode = b.barcode AND a.run < b.run GROUP BY 1, 2, 3")
def run_overlap(spark, sf):
    c = orders_by_part(spark, sf).obs.select("donor", F.floor(F.col("cell_id") / 4).alias("barcode"), F.concat(F.lit("run"), (F.col("cell_id") % 4).cast("string")).alias("run")).distinct()
    return prep.run_overlap(c)


@query(BASE + ", x AS (SELECT donor AS barcode, gene, coalesce(sum(n) FILTER (cond = 0), 0) AS a, coalesce(sum(n) FILTER (cond = 1), 0) AS b FROM expr JOIN obs USING (cell_id) GROUP BY 1, 2) SELECT sum(least(a, b)) AS shared, sum(a) AS total_a, sum(b) AS total_b, round(sum(least(a, b)) / sum(a), 6) AS p_a, round(sum(least(a, b)) / sum(b), 6) AS p_b, round(2 * sum(least(a, b)) / (sum(a) + sum(b)), 6) AS repeated FROM x")
def shared_molecules(spark, sf):
    m = orders_by_part(spark, sf)
    x = m.expr.join(m.obs.select("cell_id", "donor", "cond"), "cell_id").groupBy(F.col("donor").alias("barcode"), "gene", "cond").agg(F.sum("n").alias("n"))
    return prep.shared_molecules(x.where("cond = 0"), x.where("cond = 1")).select("shared", "total_a", "total_b", *r6("p_a", "p_b", "repeated"))


@query(BASE + " SELECT celltype, count(*) FILTER (status = 'F') AS f, count(*) FILTER (status = 'O') AS o, count(*) FILTER (status = 'P') AS p FROM obs GROUP BY 1")
def crosstab(spark, sf):
    x = prep.crosstab(orders_by_part(spark, sf).obs, "celltype", "status", ["F", "O", "P"])
    return x.select("celltype", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query(with_stats(10) + f", w AS (SELECT celltype, {STRICT} AS why FROM stats) SELECT celltype, why AS skip_reason, count(*) AS genes FROM w GROUP BY 1, 2")
def skip_diagnostics(spark, sf):
    return _stats(spark, sf).groupBy("celltype", "skip_reason").agg(F.count("*").alias("genes"))


@query(BASE + """ SELECT 'cell_id_unique' AS rule, count(*) AS violations FROM (SELECT cell_id FROM obs GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'condition_known', count(*) FROM obs WHERE cond IS NULL OR cond NOT IN (0, 1)
UNION ALL SELECT 'counts_whole', count(*) FROM expr WHERE n < 0 OR isnan(n) OR n <> round(n)
UNION ALL SELECT 'pairs_unique', count(*) FROM (SELECT 1 FROM expr GROUP BY cell_id, gene HAVING count(*) > 1)
UNION ALL SELECT 'cells_known', count(*) FROM expr ANTI JOIN obs USING (cell_id)
UNION ALL SELECT 'donor_in_one_condition', count(*) FROM (SELECT donor FROM obs GROUP BY 1 HAVING count(DISTINCT cond) > 1)""")
def contract_checks(spark, sf):
    m = orders_by_part(spark, sf)
    return prep.check_contract(m.obs, m.expr, unpaired=True)


@query(PB_DENSE + ", m AS (SELECT celltype, gene, avg(n) AS mean, var_samp(n) AS var FROM pbd GROUP BY 1, 2) SELECT celltype, gene, round(mean, 9) AS mean, round(least(20.0, greatest(1e-3, coalesce((var - mean) / nullif(mean * mean, 0), 1e-3))), 4) AS dispersion FROM m")
def nb_params(spark, sf):
    m = orders_by_part(spark, sf)
    return prep.nb_moments(pseudobulk.sums(m.expr, m.obs, pseudobulk.samples(m.obs), m.var)).select("celltype", "gene", F.round("mean", 9).alias("mean"), F.round("dispersion", 4).alias("dispersion"))


@query(WITH_SUFF + " SELECT celltype, round(regr_slope(s_test, s_ref), 6) AS slope, round(corr(s_test, s_ref) ^ 2, 6) AS r2 FROM dense GROUP BY 1")
def regr_scaling(spark, sf):
    d = _dense(spark, sf)
    return d.groupBy("celltype").agg(F.round(F.regr_slope("s_test", "s_ref"), 6).alias("slope"), F.round(F.pow(F.corr("s_test", "s_ref"), F.lit(2.0)), 6).alias("r2"))


@query(WITH_SUFF + """, j AS (SELECT celltype, gene, abs(s_ref / n_ref - s_test / n_test) AS d, abs(s_ref / n_ref - s_test / n_test) / greatest(abs(s_ref / n_ref), abs(s_test / n_test), 1e-8) AS r FROM dense)
SELECT celltype, count(*) AS n, round(max(d), 6) AS max_abs, round(median(d), 6) AS median_abs, round(max(r), 6) AS max_rel, round(median(r), 6) AS median_rel, round(avg(CASE WHEN r <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS within FROM j GROUP BY 1""")
def rel_diff_agreement(spark, sf):
    d = hurdle.describe(_dense(spark, sf))
    a, b = d.select("celltype", "gene", F.col("mean_expr_ref").alias("v")), d.select("celltype", "gene", F.col("mean_expr_test").alias("v"))
    return compare.agreement(a, b, "v", 0.1).select("celltype", "n", *r6("max_abs", "median_abs", "max_rel", "median_rel", "within"))


@query("WITH " + ORDERS_BY_PART_SQL + " SELECT gene FROM var WHERE upper(gene) IN (SELECT upper(p_brand || '|' || p_type) FROM part WHERE p_size <= 5)")
def semi_members(spark, sf):
    m = orders_by_part(spark, sf)
    listed = table(spark, sf, "part").where("p_size <= 5").select(F.lower(F.concat_ws("|", "p_brand", "p_type")).alias("gene"))
    return prep.members(m.var, listed)


@query(ADJUSTED + ", o AS (SELECT celltype, gene, round(p, 9) AS p, row_number() OVER (PARTITION BY celltype ORDER BY p, gene) AS k FROM adj WHERE p IS NOT NULL), l AS (SELECT celltype, p, lag(p) OVER (PARTITION BY celltype ORDER BY k) AS before FROM o) SELECT celltype, bool_and(before IS NULL OR before <= p) AS in_order FROM l GROUP BY 1")
def monotone_order(spark, sf):
    w = Window.partitionBy("celltype").orderBy("p", "gene")
    x = _adjusted(spark, sf).where("p IS NOT NULL").select("celltype", F.round("p", 9).alias("p"), "gene")
    x = x.withColumn("before", F.lag("p").over(w))
    return x.groupBy("celltype").agg(F.bool_and(F.col("before").isNull() | (F.col("before") <= F.col("p"))).alias("in_order"))


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf):
    """Windowed counts of events read as a stream, to the end of what is there."""
    from ..streaming import suff_stats as stream

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.to_the_end(stream.windowed_counts(events, late="3650 days"), "windowed-counts")
    return counts.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


@query(TWO + """, j AS (SELECT celltype, ma.log2fc AS x, mb.log2fc AS y, ma.nlp AS p, mb.nlp AS q, ma.fdr AS f, mb.fdr AS g FROM ma JOIN mb USING (celltype, gene))
SELECT celltype, count(*) AS n_genes, round(max(abs(x - y)), 6) AS max_log2fc, round(max(abs(p - q)), 6) AS max_neglog10p, round(max(abs(f - g)), 6) AS max_fdr, count(*) FILTER (coalesce(f < 0.3, false) <> coalesce(g < 0.3, false)) AS changed_calls,
bool_and(x IS NOT DISTINCT FROM y AND p IS NOT DISTINCT FROM q AND f IS NOT DISTINCT FROM g) AS identical FROM j GROUP BY 1""")
def order_sensitivity(spark, sf):
    a, b = _two_methods(spark, sf)
    return compare.sensitivity(a, b, 0.3).select("celltype", "n_genes", *r6("max_log2fc", "max_neglog10p", "max_fdr"), "changed_calls", "identical")


@query(TWO + " SELECT celltype, gene, CASE WHEN ma.fdr IS NULL OR mb.fdr IS NULL THEN 'untested_in_one' WHEN abs(ma.fdr - 0.5) <= 0.2 * 0.5 AND abs(mb.fdr - 0.5) <= 0.2 * 0.5 THEN 'near_boundary' ELSE 'different' END AS reason FROM ma JOIN mb USING (celltype, gene)")
def boundary_class(spark, sf):
    a, b = _two_methods(spark, sf)
    j = a.select("celltype", "gene", F.col("fdr").alias("f")).join(b.select("celltype", "gene", F.col("fdr").alias("g")), ["celltype", "gene"])
    return j.select("celltype", "gene", compare.boundary_reason(F.col("f"), F.col("g"), 0.5).alias("reason"))


def _welch_sql(name: str, where: str) -> str:
    """The sample-level statistic over some donors, under CTE names of its own."""
    return f""", g_{name} AS (SELECT * FROM good WHERE {where}),
pbd_{name} AS (SELECT g.celltype, g.sample, g.cond, v.gene, coalesce(pb.n, 0) AS n FROM g_{name} g CROSS JOIN var v LEFT JOIN pb ON pb.celltype = g.celltype AND pb.sample = g.sample AND pb.gene = v.gene)""" + WELCH.replace("pbd", f"pbd_{name}").replace("lib", f"lib_{name}").replace("wm", f"wm_{name}").replace("welch AS", f"welch_{name} AS")


@query(WITH_PB + _welch_sql("a", "true") + _welch_sql("b", "donor % 5 <> 0") + """, j AS (SELECT celltype, a.lfc AS x, b.lfc AS y, coalesce(abs(a.t) > 1.6, false) AS s, coalesce(abs(b.t) > 1.6, false) AS t FROM welch_a a JOIN welch_b b USING (celltype, gene))
SELECT celltype, round(count(*) FILTER (s AND t) / nullif(count(*) FILTER (s OR t), 0)::DOUBLE, 6) AS jaccard, count(*) FILTER (s AND NOT t) AS lost, count(*) FILTER (NOT s AND t) AS gained, round(corr(x, y), 6) AS pearson, round(median(abs(x - y)), 6) AS median_change FROM j GROUP BY 1""")
def subset_refit(spark, sf):
    m = orders_by_part(spark, sf)
    meta = pseudobulk.samples(m.obs)
    pb = pseudobulk.sums(m.expr, m.obs, meta, m.var)
    named = lambda df: pseudobulk.welch(df).select("celltype", "gene", F.col("pb_log2FC").alias("log2fc"), F.when(F.abs("pb_stat") > 1.6, 0.01).otherwise(0.5).alias("fdr"))
    return compare.refit_summary(named(pb), named(pb.where("donor % 5 <> 0"))).select("celltype", F.round("jaccard", 6).alias("jaccard"), "lost", "gained", *r6("pearson", "median_change"))


@query(BASE + """, found AS (SELECT 'n_cells' AS name, CAST(count(*) AS DOUBLE) AS value FROM obs UNION ALL SELECT 'n_celltypes', count(DISTINCT celltype) FROM obs UNION ALL SELECT 'n_genes', count(*) FROM var UNION ALL SELECT 'n_donors', count(DISTINCT donor) FROM obs),
expected(name, expected, tolerance) AS (VALUES ('n_cells', 15000.0, 2000.0), ('n_celltypes', 5.0, 0.0), ('n_genes', -1.0, 0.5), ('n_planets', 8.0, 0.0), ('n_donors', 24.0, 1.0))
SELECT name, CASE WHEN value IS NULL THEN 'MISSING' WHEN abs(value - expected) <= tolerance THEN 'OK' ELSE 'MISMATCH' END AS status FROM expected LEFT JOIN found USING (name)""")
def claims(spark, sf):
    m = orders_by_part(spark, sf)
    n = m.obs.agg(F.count("*").cast("double").alias("value")).select(F.lit("n_cells").alias("name"), "value")
    n = n.unionByName(m.obs.agg(F.count_distinct("celltype").cast("double").alias("value")).select(F.lit("n_celltypes").alias("name"), "value"))
    n = n.unionByName(m.var.agg(F.count("*").cast("double").alias("value")).select(F.lit("n_genes").alias("name"), "value"))
    n = n.unionByName(m.obs.agg(F.count_distinct("donor").cast("double").alias("value")).select(F.lit("n_donors").alias("name"), "value"))
    expected = spark.createDataFrame([("n_cells", 15000.0, 2000.0), ("n_celltypes", 5.0, 0.0), ("n_genes", -1.0, 0.5), ("n_planets", 8.0, 0.0), ("n_donors", 24.0, 1.0)], "name string, expected double, tolerance double")
    return compare.verdict(n, expected).select("name", "status")


# ---------------------------------------------------------------- lookups, gates and orders


@query(BASE + ", t AS (SELECT gene, sum(n) AS total, row_number() OVER (ORDER BY sum(n) DESC, gene) AS r FROM expr GROUP BY 1) SELECT gene, CAST(total AS DOUBLE) AS total FROM t WHERE r > 50 AND total > 0")
def without_top_genes(spark, sf):
    return prep.without_top_genes(orders_by_part(spark, sf).expr, 50).groupBy("gene").agg(F.sum("n").cast("double").alias("total"))


@query(BASE + ", t AS (SELECT gene, row_number() OVER (ORDER BY sum(n) DESC, gene) AS r FROM expr GROUP BY 1), v AS (SELECT gene, row_number() OVER (ORDER BY md5(gene)) AS pos FROM var) SELECT gene, row_number() OVER (ORDER BY pos) AS place FROM v WHERE gene IN (SELECT gene FROM t WHERE r <= 40)")
def top_genes_in_order(spark, sf):
    m = orders_by_part(spark, sf)
    kept = prep.keep_top_genes(m.var.withColumn("gene_pos", F.md5("gene")), m.expr, 40)
    return kept.select("gene", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gene_pos")).cast("long").alias("place"))


@query("SELECT c_custkey AS custkey, coalesce(n_name, regexp_replace(c_name, 'Customer#0*', 'c')) AS donor_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <= 2) ON n_nationkey = c_nationkey")
def lookup_with_fallback(spark, sf):
    names = table(spark, sf, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("donor"), F.col("n_name").alias("name"))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("donor"), "c_name")
    return prep.looked_up(rows, "donor", names, "donor_name", F.regexp_replace("c_name", "Customer#0*", "c")).select(F.col("c_custkey").alias("custkey"), "donor_name")


@query(BASE + META.format(cells=10) + ", per AS (SELECT donor, count(*) AS cells FROM obs WHERE balance > 9000 GROUP BY 1) SELECT celltype, sample, n_cells, cells FROM good LEFT JOIN per USING (donor)")
def sample_cell_counts(spark, sf):
    obs = orders_by_part(spark, sf).obs
    return prep.with_counts(pseudobulk.samples(obs), obs.where("balance > 9000")).select("celltype", "sample", "n_cells", "cells")


@query(BASE + " SELECT donor, celltype, arg_min(status, cell_id) AS first, string_agg(DISTINCT status, ',' ORDER BY status) AS every FROM obs GROUP BY 1, 2")
def first_and_all_labels(spark, sf):
    return prep.first_and_all(orders_by_part(spark, sf).obs, ["donor", "celltype"], "status", "cell_id")


@query(WITH_SUFF + " SELECT celltype, gene FROM dense WHERE c_ref > 0 AND c_test > 0 AND greatest(c_ref / n_ref::DOUBLE, c_test / n_test::DOUBLE) >= 0.025")
def gene_gate(spark, sf):
    return prep.gene_gate(_dense(spark, sf), 0.025).select("celltype", "gene")


@query(BASE + ", k AS (SELECT cell_id, sum(greatest(n - 20, 0)) AS total FROM expr GROUP BY 1 HAVING sum(greatest(n - 20, 0)) > 0) SELECT cell_id, count(*) AS genes FROM expr SEMI JOIN k USING (cell_id) GROUP BY 1")
def cells_with_counts(spark, sf):
    over = orders_by_part(spark, sf).expr.withColumn("over", F.greatest(F.col("n") - 20, F.lit(0)))
    return prep.cells_with_counts(over, "over").groupBy("cell_id").agg(F.count("*").alias("genes"))


@query(BASE + """, x AS (SELECT cell_id, gene, n, ln(1 + n * 1e4 / sum(n) OVER (PARTITION BY cell_id)) + CASE WHEN cell_id % 7 = 0 THEN 1e-3 ELSE 0 END AS value FROM expr), c AS (SELECT cell_id, sum(n) AS s, count(*) AS k FROM expr GROUP BY 1)
SELECT 'no_stored_zeros' AS rule, count(*) FILTER (n = 0) AS violations FROM x UNION ALL SELECT 'values_of_counts', count(*) FILTER (cell_id % 7 = 0) FROM x UNION ALL SELECT 'cells_with_counts', count(*) FILTER (s <= 0) FROM c
UNION ALL SELECT 'cell_sums', count(*) FILTER (cell_id % 5 = 0) FROM c UNION ALL SELECT 'cell_nnz', count(*) FILTER (k > 3) FROM c""")
def value_checks(spark, sf):
    """Rules over values that were shifted in every seventh cell, totals off by one in every fifth, and numbers held at three."""
    e = orders_by_part(spark, sf).expr
    x = prep.cp10k(e).withColumn("value", F.col("value") + F.when(F.col("cell_id") % 7 == 0, 1e-3).otherwise(0.0))
    totals = e.groupBy("cell_id").agg(F.sum("n").alias("total"), F.least(F.count("*"), F.lit(3)).alias("nnz")).withColumn("total", F.col("total") + F.when(F.col("cell_id") % 5 == 0, 1).otherwise(0))
    return prep.check_values(x, totals)


@query(BASE + """, tot AS (SELECT cell_id, sum(n) AS t FROM expr GROUP BY 1), med AS (SELECT median(t) AS m FROM tot), x AS (SELECT donor, gene, sum(n * m / t) AS s, sum((n * m / t) ^ 2) AS q FROM expr JOIN tot USING (cell_id) JOIN obs USING (cell_id), med GROUP BY 1, 2),
sz AS (SELECT donor, count(*) AS cells FROM obs GROUP BY 1), w AS (SELECT count(*) AS donors, sum(cells) AS al, avg(1.0 / cells) AS inv FROM sz),
g AS (SELECT gene, sum(s) / any_value(al) AS mu, sum(q) / any_value(al) AS e2, count(*) FILTER (s > 0) AS have, any_value(donors) AS donors, any_value(inv) AS inv, var_samp(ln(s / cells)) FILTER (s > 0) AS v FROM x JOIN sz USING (donor), w GROUP BY 1),
b AS (SELECT greatest(0.0, v - (1 / mu + least(20.0, greatest(1e-3, (e2 - mu * mu - mu) / (mu * mu)))) * inv) AS b FROM g WHERE have = donors AND mu > 0.2) SELECT round(sqrt(median(b)), 6) AS sigma_d, count(*) AS n_genes FROM b""")
def donor_spread(spark, sf):
    m = orders_by_part(spark, sf)
    return prep.donor_spread(m.expr, m.obs).select(F.round("sigma_d", 6).alias("sigma_d"), "n_genes")


@query(WITH_SUFF + """, j AS (SELECT celltype, gene, round(abs(s_ref / n_ref - s_test / n_test) / greatest(abs(s_ref / n_ref), abs(s_test / n_test), 1e-8), 6) AS r FROM dense), k AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY r DESC, gene DESC) AS k FROM j)
SELECT celltype, string_agg(gene, ';' ORDER BY k) AS worst_genes FROM k WHERE k <= 3 GROUP BY 1""")
def worst_genes(spark, sf):
    d = hurdle.describe(_dense(spark, sf))
    return compare.agreement(d.select("celltype", "gene", F.col("mean_expr_ref").alias("v")), d.select("celltype", "gene", F.col("mean_expr_test").alias("v")), "v").select("celltype", "worst_genes")


@query(with_stats(10) + f", twice AS (SELECT celltype, gene, CAST(k AS INTEGER) AS place, CASE WHEN {STRICT} = '' THEN round(sd, 6) END AS stat FROM stats, range(2) t(k) WHERE gene NOT LIKE '%BRASS') SELECT celltype, gene, stat, place FROM (SELECT celltype, gene FROM sizes CROSS JOIN var) LEFT JOIN (SELECT * FROM twice WHERE place = 0) USING (celltype, gene)")
def aligned_to_genes(spark, sf):
    s = _stats(spark, sf)
    twice = s.where(~F.col("gene").endswith("BRASS")).select("celltype", "gene", F.round("stat_detect", 6).alias("stat"), F.explode(F.array(F.lit(1), F.lit(0))).alias("place"))
    return compare.aligned(s.select("celltype", "gene"), twice, "place").select("celltype", "gene", "stat", "place")


@query(ADJUSTED + """, x AS (SELECT celltype, gene, round(p, 1) AS p, round(stat, 6) AS s, CAST(k AS INTEGER) AS run, CASE WHEN k = 0 THEN gene ELSE md5('0:' || k || ':' || gene) END AS pos FROM adj, range(5) t(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY celltype, run ORDER BY p NULLS LAST, pos) <= 20 AS a, row_number() OVER (PARTITION BY celltype, run ORDER BY s DESC NULLS LAST, pos) AS b FROM x),
o AS (SELECT celltype, run, count(*) FILTER (a AND b <= 20) AS shared, list(gene ORDER BY gene) FILTER (a) AS p, string_agg(gene, ';' ORDER BY b) FILTER (b <= 20) AS best FROM r GROUP BY 1, 2),
l AS (SELECT *, lag(p) OVER (PARTITION BY celltype ORDER BY run) AS before FROM o)
SELECT celltype, min(shared) AS overlap_min, median(shared) AS overlap_median, max(shared) AS overlap_max, round(min(CASE WHEN before IS NOT NULL THEN len(list_intersect(p, before)) / (40.0 - len(list_intersect(p, before))) END), 6) AS jaccard_min, count(DISTINCT best) = 1 AS statistic_identical FROM l GROUP BY 1""")
def order_overlap(spark, sf):
    """The twenty best genes by p of one digit, and by the statistic, over five orders of the input."""
    a = _adjusted(spark, sf).select("celltype", "gene", F.round("p", 1).alias("p"), F.round("stat", 6).alias("stat"))
    return compare.order_overlap(a, "p", "stat", 20, 5).withColumn("jaccard_min", F.round("jaccard_min", 6))


@query(ADJUSTED + """, x AS (SELECT celltype, gene, CASE WHEN gene LIKE '%TIN' THEN 0.0 WHEN gene LIKE '%STEEL' THEN 1.0 ELSE p END AS p FROM adj)
SELECT celltype, gene, round(CASE WHEN p > 0 THEN -log10(p) WHEN p IS NOT NULL THEN 323.0 END, 6) AS neglog10p, CASE WHEN p IS NOT NULL THEN round(ln(least(greatest(p, 1e-12), 1 - 1e-12) / (1 - least(greatest(p, 1e-12), 1 - 1e-12))), 5) END AS logit FROM x""")
def naive_tail_logit(spark, sf):
    p = F.when(F.col("gene").endswith("TIN"), 0.0).when(F.col("gene").endswith("STEEL"), 1.0).otherwise(F.col("p"))
    a = _adjusted(spark, sf).select("celltype", "gene", p.alias("p"))
    return a.select("celltype", "gene", F.round(columns.neglog10_naive(F.col("p")), 6).alias("neglog10p"), F.round(columns.logit(F.col("p")), 5).alias("logit"))


@query("SELECT n_nationkey AS nationkey, unnest(list_concat(range(n_nationkey, n_nationkey + 3), [CAST(n_regionkey AS BIGINT)])) AS number FROM nation")
def range_spec(spark, sf):
    n = table(spark, sf, "nation").withColumn("spec", F.concat(F.col("n_nationkey").cast("string"), F.lit("-"), (F.col("n_nationkey") + 2).cast("string"), F.lit(", ,"), F.col("n_regionkey").cast("string")))
    return n.select(F.col("n_nationkey").alias("nationkey"), F.explode(columns.numbers(F.col("spec")).cast("array<bigint>")).alias("number"))


def _pair_sql(a: str, b: str) -> str:
    """The concordance of two methods, from the CTEs of their names (celltype, gene, log2fc, nlp, fdr), tested genes alone."""
    top = lambda m: f"SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY nlp DESC NULLS LAST, gene) <= 20 AS top, count(*) FILTER (coalesce(fdr < 0.3, false)) OVER (PARTITION BY celltype) AS sig FROM {m} WHERE tested"
    ranks = ", ".join(f"rank() OVER (PARTITION BY celltype ORDER BY {c}) + (count(*) OVER (PARTITION BY celltype, {c}) - 1) / 2.0 AS r{c}" for c in "xypq")
    return f"""SELECT celltype, '{a}' AS method_a, '{b}' AS method_b, count(*) AS n_genes, round(corr(x, y), 5) AS pearson_log2fc, round(corr(rx, ry), 5) AS spearman_log2fc, round(corr(rp, rq), 5) AS spearman_neglog10p, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement,
round(count(*) FILTER (s AND t) / nullif(count(*) FILTER (s OR t), 0)::DOUBLE, 6) AS jaccard, count(*) FILTER (tt) AS topk_overlap, any_value(sig_a) AS sig_a, any_value(sig_b) AS sig_b FROM (SELECT *, {ranks} FROM (SELECT celltype, gene, t1.log2fc AS x, t2.log2fc AS y, t1.nlp AS p, t2.nlp AS q, t1.fdr < 0.3 AS s, t2.fdr < 0.3 AS t, t1.top AND t2.top AS tt, t1.sig AS sig_a, t2.sig AS sig_b
FROM ({top(a)}) t1 JOIN ({top(b)}) t2 USING (celltype, gene) WHERE t1.log2fc IS NOT NULL AND t2.log2fc IS NOT NULL AND t1.nlp IS NOT NULL AND t2.nlp IS NOT NULL)) GROUP BY celltype HAVING count(*) >= 5"""


THREE = TWO.replace("ma AS (", "cell AS (").replace("mb AS (", "sample AS (") + ", " + RANKS[RANKS.index("pos AS (") :] + """,
scores AS (SELECT celltype, gene, (w - n_test * (n_cells + 1) / 2.0) / sqrt(n_test::DOUBLE * n_ref * (n_cells + 1) / 12.0) AS s FROM z)""" + normal_sql("scores", "s", "rq") + """,
ranks AS (SELECT celltype, gene, s AS log2fc, -lp / ln(10) AS nlp, q AS fdr, true AS tested FROM rq)"""


@query(THREE + " " + " UNION ALL ".join(_pair_sql(a, b) for a, b in (("cell", "sample"), ("cell", "ranks"), ("sample", "ranks"))))
def method_pairs(spark, sf):
    """Concordance of each two of three methods: cells, samples, rank sums."""
    m = orders_by_part(spark, sf)
    a, b = _two_methods(spark, sf)
    z = _normal(ranksum.rank_sum(m.expr, m.obs, condition.group_sizes(m.obs)), "z").select("celltype", "gene", F.col("z").alias("log2fc"), "neglog10p", "pvalue", "fdr", F.lit(True).alias("tested"))
    c = compare.pairwise(a.unionByName(b).unionByName(compare.harmonise(z, "ranks")), ["cell", "sample", "ranks"], 20, 0.3)
    return c.select("celltype", "method_a", "method_b", "n_genes", *[F.round(x, 5).alias(x) for x in ("pearson_log2fc", "spearman_log2fc", "spearman_neglog10p")], *r6("sign_agreement", "jaccard"), "topk_overlap", "sig_a", "sig_b")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the whole two-part result of the driver's orders."""
    m = orders_by_part(spark, sf)
    return api.two_part(m.expr, m.obs, m.var, api.preset(LOGGED))[0]

"""Queries of the comparators that know donors or samples, with the same in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import native
from ..operators import condition, hurdle, mixed, penalised, pseudobulk, weighted
from ..operators.kept import keep
from ..sources.mappings import orders_by_part
from . import tails_sql
from .queries import BASE, WITH_PB, query, with_stats

# ---------------------------------------------------------------- donor random effects


def _glmm_sql() -> str:
    """The logistic random-intercept fits as a recursion over steps: rows are (model, gene, donor), a gene's sums are windows."""
    x, w = np.polynomial.hermite.hermgauss(mixed.NODES)
    nodes = f"[{', '.join(f'{{x: {float(a)!r}::DOUBLE, w: {float(b)!r}::DOUBLE}}' for a, b in zip(x, np.log(w) + x * x, strict=True))}]"
    eta0, eta1 = "(b0 + s * z)", "(b0 + b1 + s * z)"
    held = lambda e: f"least(30.0, greatest(-30.0, {e}))"
    p = lambda e: f"(1 / (1 + exp(-{held(e)})))"
    h = f"(s * s * (n0 * {p(eta0)} * (1 - {p(eta0)}) + n1 * {p(eta1)} * (1 - {p(eta1)})) + 1)"
    move = f"z + least({mixed.LONGEST}, greatest(-{mixed.LONGEST}, (s * (k0 - n0 * {p(eta0)} + k1 - n1 * {p(eta1)}) - z) / {h}))"
    soft = lambda e: f"(greatest({e}, 0) + ln(1 + exp(-abs({e}))))"
    keep = "it, m, celltype, gene, donor, n0, k0, n1, k1, b0, b1, s"
    moved = "rows_"
    for _ in range(mixed.MODE_STEPS):
        moved = f"(SELECT {keep}, {move} AS z FROM {moved})"
    # at the nodes: z, log f, residual of all and of the second arm, information of both arms
    at = f"""(SELECT *, list_transform(list_transform({nodes}, lambda q: {{z: z + sqrt(2 / h) * q.x, w: q.w}}), lambda q: {{z: q.z, w: q.w, e0: {held('b0 + s * q.z')}, e1: {held('b0 + b1 + s * q.z')}}}) AS e FROM (SELECT *, {h} AS h FROM {moved}))"""
    at = f"""(SELECT *, list_transform(e, lambda q: {{z: q.z, f: k0 * q.e0 - n0 * {soft('q.e0')} + k1 * q.e1 - n1 * {soft('q.e1')} - q.z * q.z / 2 + q.w, r0: k0 - n0 / (1 + exp(-q.e0)), r1: k1 - n1 / (1 + exp(-q.e1)),
      v0: n0 / (1 + exp(-q.e0)) / (1 + exp(q.e0)), v1: n1 / (1 + exp(-q.e1)) / (1 + exp(q.e1))}}) AS g FROM {at})"""
    at = f"(SELECT *, list_max(list_transform(g, lambda q: q.f)) AS top FROM {at})"
    at = f"(SELECT *, list_transform(g, lambda q: exp(q.f - top)) AS u FROM {at})"
    at = f"(SELECT *, list_sum(u) AS total FROM {at})"
    mean = lambda c: f"list_sum(list_transform(g, lambda q: exp(q.f - top) * ({c}))) / total"
    r, v = "(q.r0 + q.r1)", "(q.v0 + q.v1)"
    scores = (r, "q.r1", f"q.z * {r}")
    designs = (("1", "1"), ("0", "1"), ("q.z", "q.z"))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    columns = [f"{mean(c)} AS g{i}" for i, c in enumerate(scores)]
    columns += [f"{mean(f'q.v0 * {designs[i][0]} * {designs[j][0]} + q.v1 * {designs[i][1]} * {designs[j][1]}')} AS a{i}{j}" for i, j in pairs]
    columns += [f"{mean(f'({scores[i]}) * ({scores[j]})')} AS c{i}{j}" for i, j in pairs]
    donors = f"(SELECT {keep}, z, top + ln(total) + 0.5 * ln(2 / h) - 0.5 * ln(2 * pi()) AS ll, {', '.join(columns)} FROM {at})"
    gene = "OVER (PARTITION BY m, celltype, gene)"
    little = lambda i, j: " + 1e-9" if i == j else ""
    sums = [f"sum(ll) {gene} AS ll"] + [f"sum(g{i}) {gene} AS g{i}" for i in range(3)]
    sums += [f"sum(a{i}{j}) {gene}{little(i, j)} AS a{i}{j}" for i, j in pairs]
    sums += [f"sum(a{i}{j} - c{i}{j} + g{i} * g{j}) {gene}{little(i, j)} AS o{i}{j}" for i, j in pairs]
    summed = f"(SELECT {keep}, z, {', '.join(sums)} FROM {donors})"
    det3 = "(o00 * (o11 * o22 - o12 * o12) - o01 * (o01 * o22 - o12 * o02) + o02 * (o01 * o12 - o11 * o02))"
    good = f"CASE WHEN m = 1 THEN o00 > 0 AND o00 * o11 - o01 * o01 > 0 AND {det3} > 0 ELSE o00 > 0 AND o00 * o22 - o02 * o02 > 0 END"
    chosen = f"(SELECT {keep}, z, ll, g0, g1, g2, good, {', '.join(f'CASE WHEN good AND late THEN o{i}{j} ELSE a{i}{j} END AS i{i}{j}' for i, j in pairs)} FROM (SELECT *, {good} AS good, it >= {mixed.SCORING} AS late FROM {summed}))"
    d3 = "(i00 * (i11 * i22 - i12 * i12) - i01 * (i01 * i22 - i12 * i02) + i02 * (i01 * i12 - i11 * i02))"
    d2 = "(i00 * i22 - i02 * i02)"
    steps = (
        f"CASE WHEN m = 1 THEN (g0 * (i11 * i22 - i12 * i12) - i01 * (g1 * i22 - i12 * g2) + i02 * (g1 * i12 - i11 * g2)) / {d3} ELSE (g0 * i22 - i02 * g2) / {d2} END",
        f"CASE WHEN m = 1 THEN (i00 * (g1 * i22 - i12 * g2) - g0 * (i01 * i22 - i12 * i02) + i02 * (i01 * g2 - g1 * i02)) / {d3} ELSE 0.0 END",
        f"CASE WHEN m = 1 THEN (i00 * (i11 * g2 - g1 * i12) - i01 * (i01 * g2 - g1 * i02) + g0 * (i01 * i12 - i11 * i02)) / {d3} ELSE (i00 * g2 - g0 * i02) / {d2} END",
    )
    clip = lambda c: f"least({mixed.LONGEST}, greatest(-{mixed.LONGEST}, {c}))"
    n_steps = mixed.SCORING + mixed.NEWTON
    last = f"it = {n_steps}"
    new = [f"CASE WHEN {last} THEN {b} ELSE {b} + {clip(c)} END AS {b}" for b, c in zip(("b0", "b1", "s"), steps, strict=True)]
    var = f"CASE WHEN m = 1 AND good THEN sqrt((i00 * i22 - i02 * i02) / {d3}) END"
    stepped = f"SELECT it + 1 AS it, m, celltype, gene, donor, n0, k0, n1, k1, {', '.join(new)}, z, ll, {var} AS se FROM {chosen}"
    start = "ln((sum({k}) OVER g + 0.5) / (sum({n}) OVER g - sum({k}) OVER g + 0.5))"
    r0, r1, both = start.format(k="k0", n="n0"), start.format(k="k1", n="n1"), start.format(k="(k0 + k1)", n="(n0 + n1)")
    return BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
donors AS (SELECT celltype, donor, count(*) FILTER (cond = 0)::DOUBLE AS n0, count(*) FILTER (cond = 1)::DOUBLE AS n1 FROM obs GROUP BY 1, 2),
hit AS (SELECT celltype, gene, donor, count(*) FILTER (cond = 0)::DOUBLE AS k0, count(*) FILTER (cond = 1)::DOUBLE AS k1 FROM expr JOIN obs USING (cell_id) WHERE value > 0 GROUP BY 1, 2, 3),
data AS (SELECT celltype, gene, donor, n0, n1, coalesce(k0, 0) AS k0, coalesce(k1, 0) AS k1 FROM donors CROSS JOIN var LEFT JOIN hit USING (celltype, gene, donor)),
rows_(it, m, celltype, gene, donor, n0, k0, n1, k1, b0, b1, s, z, ll, se) AS (
  SELECT 0, m, celltype, gene, donor, n0, k0, n1, k1, CASE WHEN m = 1 THEN {r0} ELSE {both} END, CASE WHEN m = 1 THEN {r1} - {r0} ELSE 0.0 END, {mixed.START_S}::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
  FROM data CROSS JOIN (VALUES (0), (1)) AS v(m) WINDOW g AS (PARTITION BY m, celltype, gene)
  UNION ALL {stepped.replace('FROM rows_', f'FROM (SELECT * FROM rows_ WHERE it <= {n_steps})')}),
fits AS (SELECT m, celltype, gene, any_value(b0) AS b0, any_value(b1) AS b1, any_value(abs(s)) AS s, any_value(ll) AS ll, any_value(se) AS se, sum(k0 + k1) AS k, sum(n0 + n1) AS n, least(sum(n0), sum(n1)) AS least, least(sum(k0), sum(k1), sum(n0 - k0), sum(n1 - k1)) = 0 AS separated FROM rows_ WHERE it = {n_steps + 1} GROUP BY 1, 2, 3)
SELECT f.celltype, f.gene, CASE WHEN NOT f.separated THEN round(f.b0, 4) END AS b0, CASE WHEN NOT f.separated THEN round(f.b1, 4) END AS beta, round(f.s, 4) AS sd_donor, CASE WHEN NOT f.separated THEN round(f.se, 4) END AS se, round(greatest(2 * (f.ll - o.ll), 0.0), 4) AS stat
FROM fits AS f JOIN fits AS o USING (celltype, gene) WHERE f.m = 1 AND o.m = 0 AND f.k > 0 AND f.k < f.n AND f.least > 0"""


@query(_glmm_sql())
def glmm_detection(spark, sf):
    m = orders_by_part(spark, sf)
    found = mixed.glmm_detection(mixed.donor_sums(m.expr, m.obs, m.var)).where("stat IS NOT NULL")
    return found.select("celltype", "gene", *[F.round(c, 4).alias(c) for c in ("b0", "beta", "sd_donor", "se", "stat")])


@query()
def glmm_counts(spark, sf):
    m = orders_by_part(spark, sf)
    return mixed.glmm_counts(mixed.donor_sums(m.expr, m.obs, m.var))


@query()
def glmm_hurdle(spark, sf):
    m = orders_by_part(spark, sf)
    return mixed.glmm_hurdle(mixed.donor_sums(m.expr, m.obs, m.var))


# ---------------------------------------------------------------- detection under a prior


def _penalised_sql() -> str:
    """The fold as a recursion over steps; ``m`` is 1 for the full model, 0 without a difference of the arms."""
    s0, s1 = penalised.SCALES
    p0, p1 = "(1 / (1 + exp(-b0)))", "(1 / (1 + exp(-b0 - b1)))"
    w = f"SELECT *, n_ref * {p0} * (1 - {p0}) AS w0, n_test * {p1} * (1 - {p1}) AS w1 FROM fit WHERE it < {penalised.STEPS}"
    g = f"SELECT *, w1 * (b0 + b1) + c_test - n_test * {p1} AS g1, w0 * b0 + c_ref - n_ref * {p0} AS g0 FROM ({w})"
    a = f"SELECT *, w0 + w1 + 1 / v0 AS a00, CASE WHEN m = 1 THEN w1 ELSE 0 END AS a01, CASE WHEN m = 1 THEN w1 + 1 / v1 ELSE 1 END AS a11, g0 + g1 AS h0, CASE WHEN m = 1 THEN g1 ELSE 0 END AS h1 FROM ({g})"
    x = f"SELECT *, (h0 * a11 - h1 * a01) / (a00 * a11 - a01 * a01) AS x0, (a00 * h1 - a01 * h0) / (a00 * a11 - a01 * a01) AS x1, a11 / (a00 * a11 - a01 * a01) AS q0, a00 / (a00 * a11 - a01 * a01) AS q1 FROM ({a})"
    soft = lambda k, n, e: f"({k} * ({e}) - {n} * (greatest({e}, 0) + ln(1 + exp(-abs({e})))))"
    return with_stats(10).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
fit(it, m, celltype, gene, c_ref, c_test, n_ref, n_test, b0, b1, v0, v1, se) AS (
  SELECT 0, m, celltype, gene, c_ref::DOUBLE, c_test::DOUBLE, n_ref::DOUBLE, n_test::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, {s0 * s0}::DOUBLE, {s1 * s1}::DOUBLE, 0.0::DOUBLE FROM stats CROSS JOIN (VALUES (0), (1)) AS v(m) WHERE dd = 1
  UNION ALL SELECT it + 1, m, celltype, gene, c_ref, c_test, n_ref, n_test, x0, x1, (x0 * x0 + q0 + {s0 * s0}) / 2, (x1 * x1 + q1 + {s1 * s1}) / 2, sqrt(q1) FROM ({x})),
done AS (SELECT *, {soft('c_ref', 'n_ref', 'b0')} + {soft('c_test', 'n_test', 'b0 + b1')} AS ll FROM fit WHERE it = {penalised.STEPS}),
pair AS (SELECT a.*, greatest(0.0, 2 * (a.ll - b.ll)) AS stat FROM done AS a JOIN done AS b USING (celltype, gene) WHERE a.m = 1 AND b.m = 0)
SELECT celltype, gene, round(b0, 6) AS b0, round(b1, 6) AS b1, round(se, 6) AS se_b1, round(stat, 6) AS stat_detect, round(exp({tails_sql.chi2_log_tail('stat', '1')}), 6) AS p_detect,
  round(stat + sc, 6) AS stat_hurdle, CASE WHEN dc = 1 THEN round(exp(-(stat + sc) / 2), 6) END AS p_hurdle
FROM pair JOIN (SELECT celltype, gene, sc, dc FROM stats) AS s USING (celltype, gene)"""


@query(_penalised_sql())
def bias_reduced_detection(spark, sf):
    """Detection under Cauchy priors, alone and with the continuous part."""
    m = orders_by_part(spark, sf)
    dense = hurdle.densify(hurdle.sufficient(m.expr, m.obs), condition.group_sizes(m.obs), m.var)
    both = hurdle.continuous(penalised.detection(hurdle.describe(dense)), 10).where("df_detect = 1").withColumn("stat_hurdle", F.col("stat_detect") + F.col("stat_continuous"))
    p = F.exp(native.chi2_log_tail(F.col("stat_detect"), F.lit(1))).alias("p_detect")
    hurdle_p = F.when(F.col("df_continuous") == 1, F.exp(-F.col("stat_hurdle") / 2)).alias("p_hurdle")
    out = both.select("celltype", "gene", "b0", "b1", "se_b1", "stat_detect", p, "stat_hurdle", hurdle_p)
    return out.select("celltype", "gene", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


# ---------------------------------------------------------------- precision weights and blocks

_OVER = "(PARTITION BY celltype)"
LIBRARIES = WITH_PB + f""", pbd AS (SELECT g.celltype, g.sample, g.donor, g.cond, v.gene, coalesce(pb.n, 0) AS n FROM good g CROSS JOIN var v LEFT JOIN pb ON pb.celltype = g.celltype AND pb.sample = g.sample AND pb.gene = v.gene),
lib0 AS (SELECT celltype, sample, any_value(cond) AS cond, sum(n) AS lib FROM pbd GROUP BY 1, 2), arm AS (SELECT celltype, min(m) AS m FROM (SELECT celltype, cond, count(*) AS m FROM lib0 GROUP BY 1, 2) GROUP BY 1),
cut AS (SELECT celltype, 10 / quantile_cont(lib, 0.5) * 1e6 AS cut, any_value(CASE WHEN m > 10 THEN 10 + (m - 10) * 0.7 ELSE m END) AS need FROM lib0 JOIN arm USING (celltype) GROUP BY 1),
kept AS (SELECT celltype, gene FROM pbd JOIN lib0 USING (celltype, sample) JOIN cut USING (celltype) GROUP BY 1, 2 HAVING count(*) FILTER (n / lib * 1e6 >= cut) >= max(need) - 1e-14 AND sum(n) >= 15),
x AS (SELECT * FROM pbd SEMI JOIN kept USING (celltype, gene)),
lib AS (SELECT celltype, sample, sum(n)::DOUBLE AS lib, quantile_cont(n, 0.75) / sum(n) AS quartile FROM x GROUP BY 1, 2),
ref AS (SELECT celltype, sample FROM (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY abs(quartile - mq), sample) AS r FROM (SELECT *, avg(quartile) OVER {_OVER} AS mq FROM lib)) WHERE r = 1),
on_ref AS (SELECT celltype, gene, n AS rn, lib AS rl FROM x JOIN lib USING (celltype, sample) SEMI JOIN ref USING (celltype, sample) WHERE n > 0),
pairs AS (SELECT celltype, sample, log2((n / lib) / (rn / rl)) AS ratio, (log2(n / lib) + log2(rn / rl)) / 2 AS mean, (1 - n / lib) / n + (1 - rn / rl) / rn AS v FROM x JOIN lib USING (celltype, sample) JOIN on_ref USING (celltype, gene) WHERE n > 0),
placed AS (SELECT *, count(*) OVER s AS m, rank() OVER (PARTITION BY celltype, sample ORDER BY round(ratio, 10)) + (count(*) OVER (PARTITION BY celltype, sample, round(ratio, 10)) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY celltype, sample ORDER BY round(mean, 10)) + (count(*) OVER (PARTITION BY celltype, sample, round(mean, 10)) - 1) / 2.0 AS r2 FROM pairs WINDOW s AS (PARTITION BY celltype, sample)),
f AS (SELECT celltype, sample, CASE WHEN max(abs(ratio)) < 1e-6 THEN 0.0 ELSE sum(ratio / v) FILTER (v > 0) / sum(1 / v) FILTER (v > 0) END AS f FROM placed WHERE r1 BETWEEN floor(m * {weighted.TRIM_RATIO}) + 1 AND m - floor(m * {weighted.TRIM_RATIO}) AND r2 BETWEEN floor(m * {weighted.TRIM_MEAN}) + 1 AND m - floor(m * {weighted.TRIM_MEAN}) GROUP BY 1, 2),
libs AS (SELECT celltype, sample, lib, pow(2, coalesce(f, 0) - avg(coalesce(f, 0)) OVER {_OVER}) AS factor FROM lib LEFT JOIN f USING (celltype, sample))"""
POINTS = LIBRARIES + """, rows_ AS (SELECT x.*, lib * factor AS lib, log2((n + 0.5) / (lib * factor + 1) * 1e6) AS y FROM x JOIN libs USING (celltype, sample)),
sums AS (SELECT celltype, gene, count(*) AS m, count(*) FILTER (cond = 0) AS w0, count(*) FILTER (cond = 1) AS w1, avg(y) FILTER (cond = 0) AS mean0, avg(y) FILTER (cond = 1) AS mean1, sum(y * y) AS q, avg(y) AS a, avg(log2(lib + 1)) AS l FROM rows_ GROUP BY 1, 2),
points AS (SELECT celltype, gene, a + l - log2(1e6) AS x, sqrt(sqrt(greatest(q - w0 * mean0 * mean0 - w1 * mean1 * mean1, 0) / (m - 2))) AS y, mean0, mean1 FROM sums WHERE w0 > 0 AND w1 > 0 AND m > 2)"""


def _between_sql(x: str) -> str:
    at = f"least(greatest(({x} - lo) / step, 0.0), {weighted.PLACES - 1}.0)"
    j = f"CAST(least(floor({at}), {weighted.PLACES - 2}) AS INTEGER)"
    return f"(curve[{j} + 1] + ({at} - {j}) * (curve[{j} + 2] - curve[{j} + 1]))"


def _trend_sql() -> str:
    """CTEs up to ``curve`` (celltype, lo, step, curve): a round after the other."""
    p = weighted.PLACES
    out = POINTS + f""", extent AS (SELECT celltype, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {p - 1} AS step, greatest(least(count(*), CAST(floor({weighted.SPAN} * count(*) + 1e-7) AS BIGINT)), 2) AS k FROM points GROUP BY 1),
spots AS (SELECT *, lo + j * step AS a FROM extent, unnest(range(0, {p})) AS u(j)), numbered AS (SELECT celltype, x, row_number() OVER (PARTITION BY celltype ORDER BY x, gene) AS r FROM points),
runs AS (SELECT f.celltype, f.x AS head, l.x AS tail FROM numbered AS f JOIN extent USING (celltype) JOIN numbered AS l ON l.celltype = f.celltype AND l.r = f.r + k - 1),
spot AS (SELECT celltype, j, any_value(a) AS a, any_value(lo) AS lo, any_value(hi) AS hi, any_value(step) AS step, min(greatest(a - head, tail - a)) AS h FROM spots JOIN runs USING (celltype) GROUP BY 1, 2),
trust0 AS (SELECT celltype, x, y, 1.0::DOUBLE AS trust FROM points)"""
    r = "abs(x - a)"
    for k in range(weighted.ROUNDS + 1):
        w = f"trust * CASE WHEN {r} <= 0.001 * h THEN 1.0 WHEN {r} <= 0.999 * h THEN pow(1 - pow({r} / h, 3), 3) ELSE 0.0 END"
        out += f""", t{k} AS (SELECT celltype, j, any_value(lo) AS lo, any_value(hi) AS hi, any_value(step) AS step, sum(w) AS t0, sum(w * d) AS t1, sum(w * d * d) AS t2, sum(w * y) AS ty, sum(w * d * y) AS txy FROM (SELECT *, x - a AS d, {w} AS w FROM trust{k} JOIN spot USING (celltype)) WHERE w > 0 GROUP BY 1, 2),
fit{k} AS (SELECT *, ty / t0 - (t1 / t0) * CASE WHEN sqrt(greatest(t2 / t0 - t1 / t0 * t1 / t0, 0)) > 0.001 * (hi - lo) THEN (txy / t0 - t1 / t0 * ty / t0) / (t2 / t0 - t1 / t0 * t1 / t0) ELSE 0.0 END AS fit FROM t{k}),
curve{k} AS (SELECT celltype, any_value(lo) AS lo, any_value(step) AS step, list(fit ORDER BY j) AS curve FROM fit{k} GROUP BY 1)"""
        if k < weighted.ROUNDS:
            out += f""", rest{k} AS (SELECT celltype, x, y, abs(y - {_between_sql('x')}) AS rest FROM trust{k} JOIN curve{k} USING (celltype)),
scale{k} AS (SELECT celltype, 6 * quantile_cont(rest, 0.5) AS c, avg(rest) AS m FROM rest{k} GROUP BY 1),
trust{k + 1} AS (SELECT celltype, x, y, CASE WHEN c <= 1e-7 * m OR rest / c <= 0.001 THEN 1.0 WHEN rest / c <= 0.999 THEN pow(1 - pow(rest / c, 2), 2) ELSE 0.0 END AS trust FROM rest{k} JOIN scale{k} USING (celltype))"""
    return out + f", curve AS (SELECT * FROM curve{weighted.ROUNDS})"


WEIGHTED = _trend_sql() + f""", weighed AS (SELECT r.*, pow({_between_sql('(CASE WHEN cond = 0 THEN mean0 ELSE mean1 END + log2(lib + 1) - log2(1e6))')}, -4) AS w FROM rows_ AS r JOIN (SELECT celltype, gene, mean0, mean1 FROM points) USING (celltype, gene) JOIN curve USING (celltype))"""
_WEIGHTED_FIT = """, ws AS (SELECT celltype, gene, count(*) AS m, sum(w) FILTER (cond = 0) AS w0, sum(w) FILTER (cond = 1) AS w1, sum(w * y) FILTER (cond = 0) AS s0, sum(w * y) FILTER (cond = 1) AS s1, sum(w * y * y) AS q FROM weighed GROUP BY 1, 2),
wf AS (SELECT celltype, gene, s1 / w1 - s0 / w0 AS beta, (q - s0 * s0 / w0 - s1 * s1 / w1) / (m - 2) AS s2, 1 / w0 + 1 / w1 AS vcoef FROM ws)
SELECT celltype, gene, round(beta, 6) AS beta, round(s2, 6) AS s2, round(beta / sqrt(s2 * vcoef), 6) AS t FROM wf"""


def _samples_of(spark, sf):
    m = orders_by_part(spark, sf)
    pb = keep(pseudobulk.sums(m.expr, m.obs, pseudobulk.samples(m.obs), m.var), "samples")
    return keep(weighted.expressed(pb), "expressed")


def _weighed(spark, sf):
    pb = _samples_of(spark, sf)
    rows = weighted.log_counts(pb, keep(weighted.library_sizes(pb), "libraries"))
    points = keep(weighted.trend_points(rows), "points")
    return keep(weighted.weights(rows, points, weighted.trend(points)), "weights")


def _six(*names):
    return [F.round(c, 6).alias(c) for c in names]


@query(WITH_PB + """, pbd AS (SELECT g.celltype, g.sample, v.gene, coalesce(pb.n, 0) AS n FROM good g CROSS JOIN var v LEFT JOIN pb ON pb.celltype = g.celltype AND pb.sample = g.sample AND pb.gene = v.gene),
l AS (SELECT *, CASE WHEN n > 0 THEN ln(n) END AS log FROM pbd), g AS (SELECT celltype, gene, sum(log) / count(*) AS mean, min(n) > 0 AS whole FROM l GROUP BY 1, 2), a AS (SELECT celltype, bool_or(whole) AS any_whole FROM g GROUP BY 1),
r AS (SELECT celltype, sample, quantile_cont(log - mean, 0.5) AS ratio, any_value(any_whole) AS any_whole FROM l JOIN g USING (celltype, gene) JOIN a USING (celltype) WHERE n > 0 AND (whole OR NOT any_whole) GROUP BY 1, 2)
SELECT celltype, sample, round(exp(ratio - CASE WHEN any_whole THEN 0 ELSE avg(ratio) OVER (PARTITION BY celltype) END), 6) AS size FROM r""")
def pb_size_factors(spark, sf):
    m = orders_by_part(spark, sf)
    return pseudobulk.size_factors(pseudobulk.sums(m.expr, m.obs, pseudobulk.samples(m.obs), m.var)).select("celltype", "sample", F.round("size", 6).alias("size"))


@query(LIBRARIES + " SELECT celltype, sample, lib, round(factor, 6) AS factor FROM libs")
def library_factors(spark, sf):
    return weighted.library_sizes(_samples_of(spark, sf)).select("celltype", "sample", "lib", F.round("factor", 6).alias("factor"))


@query(_trend_sql() + f" SELECT celltype, gene, round(x, 6) AS x, round(y, 6) AS y, round({_between_sql('x')}, 6) AS trend FROM points JOIN curve USING (celltype)")
def precision_trend(spark, sf):
    pb = _samples_of(spark, sf)
    points = keep(weighted.trend_points(weighted.log_counts(pb, weighted.library_sizes(pb))), "points")
    at = points.join(F.broadcast(weighted.trend(points)), "celltype").withColumn("trend", weighted._between(F.col("x")))
    return at.select("celltype", "gene", *_six("x", "y", "trend"))


@query(WEIGHTED + _WEIGHTED_FIT)
def weighted_samples(spark, sf):
    fit = weighted.weighted_fit(_weighed(spark, sf))
    return fit.select("celltype", "gene", *_six("beta", "s2", "t"))


def _blocks_sql() -> str:
    """CTEs up to ``agreed`` (celltype, rho)."""
    out = WEIGHTED.replace("WITH ", "WITH RECURSIVE ", 1) + """, blk AS (SELECT celltype, gene, donor, sum(w) AS v, coalesce(sum(w) FILTER (cond = 1), 0) AS v1, sum(w * y) AS s, coalesce(sum(w * y) FILTER (cond = 1), 0) AS s1, sum(w * y * y) AS q, count(*) AS n FROM weighed GROUP BY 1, 2, 3),
grid0 AS (SELECT celltype, gene, greatest(1 / (1 - max(n)) + 0.01, -MOST) AS lo, MOST::DOUBLE AS hi FROM blk GROUP BY 1, 2 HAVING max(n) > 1)""".replace("MOST", str(weighted.MOST))
    last = weighted.GRID - 1
    for k in range(weighted.GRIDS):
        out += f""", tried{k} AS (SELECT celltype, gene, lo, hi, i, lo + i * ((hi - lo) / {last}) AS rho FROM grid{k}, unnest(range(0, {weighted.GRID})) AS u(i)),
c{k} AS (SELECT t.*, b.*, rho / (1 - rho) AS ratio, rho / (1 - rho) / (1 + rho / (1 - rho) * v) AS c FROM tried{k} AS t JOIN blk AS b USING (celltype, gene)),
r{k} AS (SELECT celltype, gene, lo, hi, i, rho, sum(v - c * v * v) AS a, sum(v1 - c * v * v1) AS b, sum(v1 - c * v1 * v1) AS d, sum(s - c * v * s) AS e, sum(s1 - c * v1 * s) AS f, sum(q - c * s * s) AS q, sum(n) AS n, sum(CASE WHEN 1 + ratio * v > 0 THEN ln(1 + ratio * v) END) AS l, bool_and(1 + ratio * v > 0) AS ok FROM c{k} GROUP BY ALL),
v{k} AS (SELECT *, a * d - b * b AS det, q - (e * (d * e - b * f) + f * (a * f - b * e)) / (a * d - b * b) AS rest FROM r{k}),
best{k} AS (SELECT celltype, gene, any_value(lo) AS lo, any_value(hi) AS hi, arg_max(rho, -0.5 * (l + ln(det) + (n - 2) * ln(rest))) AS rho FROM v{k} WHERE ok AND det > 0 AND rest > 0 GROUP BY 1, 2),
grid{k + 1} AS (SELECT celltype, gene, greatest(rho - (hi - lo) / {last}, lo) AS lo, least(rho + (hi - lo) / {last}, hi) AS hi FROM best{k})"""
    return out + f""", z AS (SELECT *, 0.5 * ln((1 + rho) / (1 - rho)) AS z FROM best{weighted.GRIDS - 1}), zr AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY z, gene) AS r, count(*) OVER {_OVER} AS m FROM z),
agreed AS (SELECT celltype, tanh(avg(z)) AS rho FROM zr WHERE r > floor(m * {weighted.TRIM_CONSENSUS}) AND r <= m - floor(m * {weighted.TRIM_CONSENSUS}) GROUP BY 1)"""


BLOCKS = _blocks_sql()


@query(BLOCKS + f" SELECT celltype, gene, round(best{weighted.GRIDS - 1}.rho, 4) AS rho, round(agreed.rho, 4) AS consensus FROM best{weighted.GRIDS - 1} JOIN agreed USING (celltype)")
def block_correlation(spark, sf):
    found = weighted.correlations(weighted.block_sums(_weighed(spark, sf))).where("rho IS NOT NULL")
    found = keep(found, "correlations")
    both = found.join(F.broadcast(weighted.consensus(found).withColumnRenamed("rho", "consensus")), "celltype")
    return both.select("celltype", "gene", F.round("rho", 4).alias("rho"), F.round("consensus", 4).alias("consensus"))


@query(BLOCKS + """, one AS (SELECT celltype, gene, donor, count(*) AS n, sum(sqrt(w)) AS u, coalesce(sum(sqrt(w)) FILTER (cond = 1), 0) AS u1, sum(sqrt(w) * y) AS z, sum(w) AS a, coalesce(sum(w) FILTER (cond = 1), 0) AS b, sum(w * y) AS d, coalesce(sum(w * y) FILTER (cond = 1), 0) AS e, sum(w * y * y) AS q FROM weighed GROUP BY 1, 2, 3),
two AS (SELECT *, rho / (1 + (n - 1) * rho) AS c FROM one JOIN agreed USING (celltype)),
g AS (SELECT celltype, gene, sum(n) AS m, sum(a - c * u * u) / (1 - any_value(rho)) AS a, sum(b - c * u * u1) / (1 - any_value(rho)) AS b, sum(b - c * u1 * u1) / (1 - any_value(rho)) AS c1, sum(d - c * u * z) / (1 - any_value(rho)) AS d, sum(e - c * u1 * z) / (1 - any_value(rho)) AS e, sum(q - c * z * z) / (1 - any_value(rho)) AS q FROM two GROUP BY 1, 2),
h AS (SELECT *, (a * e - b * d) / (a * c1 - b * b) AS beta, (c1 * d - b * e) / (a * c1 - b * b) AS b0, a / (a * c1 - b * b) AS vcoef FROM g)
SELECT celltype, gene, round(beta, 5) AS beta, round((q - b0 * d - beta * e) / (m - 2), 5) AS s2, round(beta / sqrt((q - b0 * d - beta * e) / (m - 2) * vcoef), 5) AS t FROM h""")
def blocked_samples(spark, sf):
    rows = _weighed(spark, sf)
    fit = weighted.blocked_fit(rows, weighted.consensus(keep(weighted.correlations(weighted.block_sums(rows)), "correlations")))
    return fit.select("celltype", "gene", *[F.round(c, 5).alias(c) for c in ("beta", "s2", "t")])

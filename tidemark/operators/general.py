"""The two-part test with covariates: per gene a logistic and a Gaussian likelihood-ratio test.

Cells of a cell type with equal condition and covariates are alike to both fits: they are one *pattern* with a
number of cells, and a gene is its detections and the moments of its values a pattern.  Spark makes both tables;
cells and values never meet in Python.  Patterns of a cell type go in blocks of PATTERNS, genes in buckets.

* One block (the detection rate has few values): a task fits a bucket's genes at once in NumPy.
* More (continuous covariates): each step of the logistic fit is a pass over written blocks, whose sums X'WX and X'Wz
  are added up by gene; for the Gaussian fit the blocks' triangles of X v (by QR) are stacked.  A task holds a block
  and a bucket, whatever the number of cells.

A cell has a gene detected or not, however often the pair is listed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .dealing import deal
from .kept import keep

ETA, LEAST_WEIGHT, EPS = 30.0, 1e-10, 1e-12
STEPS, TOLERANCE = 100, 1e-8
#: Patterns times genes that are fitted at once.
FITTED = 2_000_000
#: Patterns of a block.
PATTERNS = 10_000
#: Patterns in which genes of a bucket are detected, in a block, on average at most.
VALUES_PER_BUCKET = 200_000
OUT = (
    "celltype string, gene string, c_ref long, c_test long, s_ref double, s_test double, df_detect int, stat_detect double, p_detect double, detect_status string, "
    "df_continuous int, stat_continuous double, beta double, s2 double, dfres long, vcoef double, skip string"
)


def _rates(x: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    eta = np.clip(x @ beta.T, -ETA, ETA)
    return eta, 1.0 / (1.0 + np.exp(-eta))


def _sums(x: np.ndarray, n: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wz of a step, for each gene: y of n cells a row of x are detections."""
    eta, mu = _rates(x, beta)
    w = np.maximum(mu * (1.0 - mu), LEAST_WEIGHT)
    m = n[:, None]
    return np.einsum("ni,ng,nj->gij", x, m * w, x, optimize=True), np.einsum("ni,ng->gi", x, m * (w * eta) + (y - m * mu))


def _loglik(x: np.ndarray, n: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    mu = _rates(x, beta)[1]
    return (y * np.log(np.maximum(mu, EPS)) + (n[:, None] - y) * np.log(np.maximum(1 - mu, EPS))).sum(0)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The coefficients of each gene; NaN where a solve failed."""
    new = np.full(b.shape, np.nan)
    try:
        new = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        for k in range(len(a)):
            try:
                new[k] = np.linalg.solve(a[k], b[k])
            except np.linalg.LinAlgError:
                pass
    return new


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS, tol: float = TOLERANCE, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, log-likelihood) for each column of y, detections of n cells (one) a row of x; NaN where a solve failed."""
    rows, p = x.shape
    n = np.ones(rows) if n is None else n
    genes = y.shape[1]
    beta, live, failed = np.zeros((genes, p)), np.ones(genes, bool), np.zeros(genes, bool)
    for _ in range(steps):
        at = np.flatnonzero(live)
        if not len(at):
            break
        new = _solved(*_sums(x, n, y[:, at], beta[at]))
        bad = ~np.isfinite(new).all(1)
        change = np.abs(new - beta[at]).max(1)
        beta[at[~bad]] = new[~bad]
        failed[at[bad]] = True
        live[at[bad | (change < tol)]] = False
    return beta, np.where(failed, np.nan, _loglik(x, n, y, beta))


def contingency(c_ref: int, n_ref: int, c_test: int, n_test: int, how: str) -> tuple[float, int, str]:
    """(statistic, df, status) of the 2x2 table by Pearson's statistic or Fisher's exact p."""
    n, c = n_ref + n_test, c_ref + c_test
    if how == "none":
        return math.nan, 0, "failed"
    if 0 in (c, n - c, n_ref, n_test):
        return 0.0, 0, "constant"
    if how == "fisher":
        p = special.hypergeometric_two_sided(c_ref, n_ref - c_ref, c_test, n_test - c_test)
        return float(special.chi2_isf_df1([min(max(p, 1e-300), 1.0)])[0]), 1, "fallback"
    d = c_ref * (n_test - c_test) - c_test * (n_ref - c_ref)
    return n * d * d / (n_ref * n_test * c * (n - c)), 1, "fallback"


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of rows' QR, square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def fit_gaussian(r: np.ndarray, n: int):
    """(statistic, beta, s2, residual df, vcoef) of the log-likelihood ratio on n positives; None where the design is singular.

    ``r``: the triangle of intercept, covariates, condition and value, so that the last two columns tell the condition's part.
    """
    p = r.shape[1] - 1
    if n <= p or not np.isfinite(r).all():
        return None
    size = np.linalg.svd(r[:, :p], compute_uv=False)
    if (size > size.max() * max(n, p) * np.finfo(float).eps).sum() < p:
        return None
    scale, gain, rss = float(r[p - 1, p - 1]), float(r[p - 1, p]), float(r[p, p]) ** 2
    stat = n * math.log(max(max(rss + gain * gain, 1e-12) / max(rss, 1e-12), 1.0))
    return max(0.0, stat), gain / scale, rss / (n - p), n - p, 1.0 / (scale * scale)


class Piece:
    """A block of patterns and the genes of a bucket there: x (1, condition, covariates) and n a pattern; at, and detections k,
    values c, their means and squared deviations m2 a gene and pattern, those of gene j from ends[j] to ends[j + 1]."""

    ARRAYS = {"x": float, "n": float, "ends": np.int64, "at": np.int64, "k": float, "c": float, "mean": float, "m2": float}
    SCHEMA = "celltype string, block int, bucket int, genes array<string>, width int, " + ", ".join(f"{k} binary" for k in ARRAYS)

    def __init__(self, genes, **arrays: np.ndarray):
        self.genes = list(genes)
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, values: pd.DataFrame, patterns: pd.DataFrame) -> Piece:
        z = np.array(patterns["z"].tolist(), float).reshape(len(patterns), -1)
        x = np.column_stack([np.ones(len(patterns)), patterns["cond"].to_numpy(float), z])
        order = np.lexsort(x.T)
        place = pd.Series(np.arange(len(order)), index=patterns["pattern"].to_numpy()[order])
        genes, gene = np.unique(values["gene"].to_numpy(str), return_inverse=True)
        at = place.reindex(values["pattern"]).to_numpy().astype(np.int64)
        sort = np.lexsort((at, gene))
        of = {c: values[c].to_numpy(float)[sort] for c in ("k", "c", "mean", "m2")}
        return cls(genes, x=np.ascontiguousarray(x[order]), n=patterns["n"].to_numpy(float)[order], ends=np.searchsorted(gene[sort], np.arange(len(genes) + 1)), at=at[sort], **of)

    @classmethod
    def read(cls, row: dict) -> Piece:
        arrays = {k: np.frombuffer(row[k], kind) for k, kind in cls.ARRAYS.items()}
        return cls(row["genes"], **(arrays | {"x": arrays["x"].reshape(-1, row["width"])}))

    def written(self) -> dict:
        return {"genes": self.genes, "width": self.x.shape[1]} | {k: np.ascontiguousarray(getattr(self, k), kind).tobytes() for k, kind in self.ARRAYS.items()}

    def design(self, null: bool) -> np.ndarray:
        return np.delete(self.x, 1, 1) if null else self.x

    def detections(self, genes: list[int]) -> np.ndarray:
        """Detections a pattern and gene; -1 for a gene without any here."""
        y = np.zeros((len(self.x), len(genes)))
        for j, g in enumerate(genes):
            if g >= 0:
                on = slice(self.ends[g], self.ends[g + 1])
                y[self.at[on], j] = self.k[on]
        return y

    def parts(self, genes: list) -> range:
        """Starts of the genes that are laid out at once, and how many these are."""
        return range(0, len(genes), max(1, FITTED // max(1, len(self.x))))

    def triangle(self, g: int) -> np.ndarray:
        on = slice(self.ends[g], self.ends[g + 1])
        rows, c = self.x[self.at[on]], np.sqrt(self.c[on])[:, None]
        r = np.column_stack([rows[:, 0], rows[:, 2:], rows[:, 1], self.mean[on]]) * c
        return triangle(np.vstack([r, np.append(np.zeros(r.shape[1] - 1), math.sqrt(self.m2[on].sum()))]))


def judged(celltype: str, gene: str, c: tuple[int, int], s: tuple[float, float], n: tuple[int, int], cells: int, gain: float, r: np.ndarray, min_positive: int, partial: bool, fallback: str) -> tuple:
    """A row of OUT: positives c, sums s and cells n of both arms; twice the gain in log-likelihood of detection (NaN: failed) and the triangle of the positives."""
    positive, skip = c[0] + c[1], ""
    varies = 0 < positive < cells
    if positive == 0:
        skip = "all_zero"
    elif not partial and positive < min_positive:
        skip = "too_few_positive"
    elif not partial and 0 in c:
        skip = "no_positive_in_one_group"
    separated = c[0] in (0, n[0]) or c[1] in (0, n[1])
    if not varies:
        stat_d, df_d, status = 0.0, 0, "constant"
    elif np.isfinite(gain):
        stat_d, df_d, status = max(0.0, gain), 1, "separated" if separated else "ok"
    else:
        stat_d, df_d, status = contingency(c[0], n[0], c[1], n[1], fallback)
    if status == "failed" and not partial and not skip:
        skip = "logistic_separation"
    found = None
    if not skip and min(c) >= 1 and positive >= min_positive:
        found = fit_gaussian(r, positive)
    if not skip and found is None and not partial:
        skip = "singular_design"
    if not skip and df_d + (found is not None) == 0:
        skip = "model_failed"
    stat_c, beta, s2, dfres, vcoef = found or (0.0, None, None, None, None)
    p_d = float(special.chi2_sf(stat_d, 1)[0]) if df_d else None
    return celltype, gene, c[0], c[1], s[0], s[1], df_d, 0.0 if not df_d else stat_d, p_d, status, int(found is not None), stat_c, beta, s2, dfres, vcoef, skip


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    out["dfres"] = out["dfres"].astype("Int64")
    return out


def fit_patterns(celltype: str, values: pd.DataFrame, patterns: pd.DataFrame, min_positive: int, partial: bool, fallback: str) -> pd.DataFrame:
    """All genes of a bucket against all patterns of a cell type."""
    p = Piece.of(values, patterns)
    cond, cells = p.x[:, 1], int(p.n.sum())
    n = tuple(int(p.n[cond == k].sum()) for k in (0, 1))
    gene = np.repeat(np.arange(len(p.genes)), np.diff(p.ends))
    c, s = ([np.bincount(gene, w * (cond[p.at] == k), len(p.genes)) for k in (0, 1)] for w in (p.c, p.c * p.mean))
    varies = (c[0] + c[1] > 0) & (c[0] + c[1] < cells)
    gain, some = np.full(len(p.genes), np.nan), np.flatnonzero(varies)
    for i in (starts := p.parts(some)):
        part = some[i : i + starts.step]
        y = p.detections(part)
        gain[part] = 2 * (fit_logistic(p.x, y, n=p.n)[1] - fit_logistic(p.design(True), y, n=p.n)[1])
    return _frame([judged(celltype, g, (int(c[0][i]), int(c[1][i])), (float(s[0][i]), float(s[1][i])), n, cells, gain[i], p.triangle(i), min_positive, partial, fallback) for i, g in enumerate(p.genes)])


def fit_genes(celltype: str, values: pd.DataFrame, cells: pd.DataFrame, names: list[str], min_positive: int, partial: bool, fallback: str) -> pd.DataFrame:
    """The same from values (cell_id, gene, value) and cells (cell_id, cond, covariates) that are at hand."""
    covariates = [c for c in names if cells[c].notna().all() and cells[c].std(ddof=0) > 0]
    cells = cells.assign(pattern=cells.groupby(["cond", *covariates], dropna=False).ngroup())
    first = cells.drop_duplicates("pattern")
    patterns = pd.DataFrame({"pattern": first["pattern"], "cond": first["cond"], "z": first[covariates].to_numpy(float).tolist()}).merge(cells.groupby("pattern").size().rename("n"), on="pattern")
    x = values[["cell_id", "gene", "value"]].merge(cells[["cell_id", "pattern"]], on="cell_id").groupby(["gene", "pattern"])
    moments = x.agg(k=("cell_id", "nunique"), c=("value", "size"), mean=("value", "mean"), m2=("value", lambda v: v.var(ddof=0) * len(v))).reset_index()
    return fit_patterns(celltype, moments, patterns, min_positive, partial, fallback)


def _with_z(cells: DataFrame, names: list[str]) -> DataFrame:
    """cell_id, celltype, cond and z: the covariates that all cells of the type have and that vary there."""
    value = [F.col(f"`{c}`").cast("double") for c in names]
    use = [(F.count_if(v.isNull() | F.isnan(v)) == 0) & (F.min(v) < F.max(v)) for v in value]
    used = cells.groupBy("celltype").agg(F.array(*use).cast("array<boolean>").alias("_use"))
    z = F.array_compact(F.array(*[F.when(F.col("_use")[i], v) for i, v in enumerate(value)])).cast("array<double>")
    return cells.join(F.broadcast(used), "celltype").select("cell_id", "celltype", F.col("cond").cast("int").alias("cond"), z.alias("z"))


def fit_all(expr: DataFrame, obs: DataFrame, names: list[str], min_positive: int = 10, partial: bool = False, fallback: str = "chisq", genes_per_bucket: int = 500, n_genes: int | None = None) -> DataFrame:
    """One row a cell type and gene with any value; genes without any are left to ``hurdle.densify``."""
    if fallback not in ("chisq", "fisher", "none"):
        raise ValueError("detection_fallback must be chisq, fisher or none")
    # written: a z that is worked out twice may differ in its last bit
    cells = keep(_with_z(obs, names), "cells")
    patterns = cells.groupBy("celltype", "cond", "z").agg(F.count("*").alias("n")).withColumn("pattern", F.monotonically_increasing_id())
    patterns = keep(patterns, "patterns")
    blocks = patterns.groupBy("celltype").agg(F.ceil(F.count("*") / PATTERNS).cast("int").alias("blocks"))
    patterns = patterns.join(F.broadcast(blocks), "celltype").withColumn("block", F.pmod(F.xxhash64("pattern"), "blocks").cast("int"))
    v = F.col("value")
    # a pair's first row by a sort, which spills: a hash table of distinct pairs would hold all of a task's
    first = F.row_number().over(Window.partitionBy("cell_id", "gene").orderBy("cell_id")) == 1
    moments = [F.count_if("first").alias("k"), F.count("*").alias("c"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2")]
    values = expr.where(v > 0).select("cell_id", "gene", "value").join(cells, "cell_id").withColumn("first", first).groupBy("celltype", "gene", "cond", "z").agg(*moments)
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("celltype", "cond", "z")]
    values = values.alias("v").join(patterns.alias("p"), same[0] & same[1] & same[2]).select("v.*", "p.pattern", "p.block", "p.blocks")
    values = keep(values, "values")
    # as many buckets as genes ask for, or the values of the fullest block
    n_genes = n_genes or values.select("gene").distinct().count()
    most = values.groupBy("celltype").agg((F.count("*") / F.max("blocks")).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, math.ceil(n_genes / genes_per_bucket), math.ceil(most / VALUES_PER_BUCKET))
    values = values.withColumn("bucket", F.pmod(F.xxhash64("gene"), F.lit(buckets)).cast("int"))
    copies = patterns.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    # aliases, so that the two sides of the cogroup share no column identities
    copies = copies.select(*[F.col(c).alias(c) for c in ("celltype", "block", "bucket", "blocks", "pattern", "cond", "z", "n")])
    whole = lambda df, one: df.where("blocks = 1" if one else "blocks > 1").groupBy("celltype", "block", "bucket")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _frame([]) if left.empty or right.empty else fit_patterns(key[0], left, right, min_positive, partial, fallback)

    out = whole(values, True).cogroup(whole(copies, True)).applyInPandas(run, OUT)
    if not blocks.where("blocks > 1").isEmpty():

        def cut(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"celltype": key[0], "block": key[1], "bucket": key[2]} | Piece.of(left, right).written()])

        pieces = keep(whole(values, False).cogroup(whole(copies, False)).applyInPandas(cut, Piece.SCHEMA), "pieces")
        out = out.unionByName(_fit_blocks(pieces, values.where("blocks > 1"), patterns.where("blocks > 1"), min_positive, partial, fallback))
    return out


# ---------------------------------------------------------------- many patterns: sums over blocks

STATE = "celltype string, bucket int, gene string, null boolean, beta array<double>, live boolean, failed boolean"


def _added(column: str):
    """Sum of arrays, place by place."""
    return F.aggregate(F.collect_list(column), F.array_repeat(F.lit(0.0), F.max(F.size(column))), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))


def _over_pieces(pieces: DataFrame, state: DataFrame, what, schema: str) -> DataFrame:
    """``what`` (piece, fits that are asked for of its bucket) of each piece: rows after celltype."""
    asked = state.groupBy("celltype", "bucket").agg(F.collect_list(F.struct("gene", "null", "beta")).alias("asked"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                rows = [{"celltype": row["celltype"]} | x for x in what(Piece.read(row), row["asked"])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    fields = _arrow(schema)
    return pieces.join(asked, ["celltype", "bucket"], "left").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _of_kinds(p: Piece, asked: list[dict]):
    """(fits, design, detections, coefficients) of some fits of a kind at a time."""
    at = {g: i for i, g in enumerate(p.genes)}
    for null in (False, True):
        fits = [f for f in asked or [] if f["null"] == null]
        for i in (starts := p.parts(fits)):
            part = fits[i : i + starts.step]
            yield part, p.design(null), p.detections([at.get(f["gene"], -1) for f in part]), np.array([f["beta"] for f in part])


def _steps(p: Piece, asked: list[dict]):
    for fits, x, y, beta in _of_kinds(p, asked):
        for f, a, b in zip(fits, *_sums(x, p.n, y, beta), strict=True):
            yield {"gene": f["gene"], "null": f["null"], "sums": np.append(a.ravel(), b).tolist()}


def _ends(p: Piece, asked: list[dict]):
    for fits, x, y, beta in _of_kinds(p, asked):
        for f, value in zip(fits, _loglik(x, p.n, y, beta), strict=True):
            yield {"gene": f["gene"], "gain": float(-2 * value if f["null"] else 2 * value), "r": None}
    for i, g in enumerate(p.genes):
        yield {"gene": g, "gain": None, "r": p.triangle(i).ravel().tolist()}


def _moved(batches):
    """The next state of fits, from the sums of a step."""
    for b in batches:
        rows = b.to_pylist()
        for row in rows:
            sums, p = np.array(row.pop("sums")), len(row["beta"])
            new = _solved(sums[None, : p * p].reshape(1, p, p), sums[None, p * p :])[0]
            if np.isfinite(new).all():
                row["live"], row["beta"] = bool(np.abs(new - row["beta"]).max() >= TOLERANCE), new.tolist()
            else:
                row["live"], row["failed"] = False, True
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _arrow(STATE))


def _fit_blocks(pieces: DataFrame, values: DataFrame, patterns: DataFrame, min_positive: int, partial: bool, fallback: str) -> DataFrame:
    """Cell types of several blocks: a pass over the pieces a step, until no fit moves."""
    arm = lambda k, c: F.coalesce(F.sum(F.when(F.col("cond") == k, c)), F.lit(0))
    n = F.col("n")
    sizes = patterns.groupBy("celltype").agg(arm(0, n).alias("n_ref"), arm(1, n).alias("n_test"), F.sum(n).alias("cells"), (F.max(F.size("z")) + 2).alias("width"))
    c, s = F.col("c"), F.col("c") * F.col("mean")
    genes = values.groupBy("celltype", "bucket", "gene").agg(*[arm(k, x).cast(t).alias(f"{a}_{b}") for a, x, t in (("c", c, "long"), ("s", s, "double")) for k, b in ((0, "ref"), (1, "test"))])
    genes = keep(genes.join(F.broadcast(sizes), "celltype"), "genes")
    zeros = F.array_repeat(F.lit(0.0), F.col("width") - F.col("null").cast("int"))
    state = genes.where("c_ref + c_test > 0 AND c_ref + c_test < cells").withColumn("null", F.explode(F.array(F.lit(False), F.lit(True))))
    state = keep(state.select("celltype", "bucket", "gene", "null", zeros.alias("beta"), F.lit(True).alias("live"), F.lit(False).alias("failed")), "state")
    done = []
    for _ in range(STEPS):
        if state.isEmpty():
            break
        sums = _over_pieces(pieces, state, _steps, "celltype string, gene string, null boolean, sums array<double>").groupBy("celltype", "gene", "null").agg(_added("sums").alias("sums"))
        state = keep(deal(state.join(sums, ["celltype", "gene", "null"]).select(*[c.split()[0] for c in STATE.split(", ")], "sums"), "celltype", "gene").mapInArrow(_moved, STATE), "state")
        done.append(state.where("NOT live"))
        state = state.where("live")
    for d in done:
        state = state.unionByName(d)
    state = keep(state, "state")
    failed = state.groupBy("celltype", "gene").agg(F.bool_or("failed").alias("failed"))
    ends = _over_pieces(pieces, state, _ends, "celltype string, gene string, gain double, r array<double>").groupBy("celltype", "gene").agg(F.sum("gain").alias("gain"), F.collect_list("r").alias("r"))
    rows = genes.join(ends, ["celltype", "gene"]).join(failed, ["celltype", "gene"], "left").withColumn("gain", F.when(~F.col("failed"), F.col("gain")))

    def run(batches):
        for b in batches:
            out = []
            for x in b.to_pylist():
                r = triangle(np.vstack([np.reshape(v, (x["width"] + 1, -1)) for v in x["r"]]))
                gain = math.nan if x["gain"] is None else x["gain"]
                out.append(judged(x["celltype"], x["gene"], (x["c_ref"], x["c_test"]), (x["s_ref"], x["s_test"]), (x["n_ref"], x["n_test"]), x["cells"], gain, r, min_positive, partial, fallback))
            if out:
                yield pa.RecordBatch.from_pandas(_frame(out), _arrow(OUT), preserve_index=False)

    return deal(rows, "celltype", "gene").mapInArrow(run, OUT)

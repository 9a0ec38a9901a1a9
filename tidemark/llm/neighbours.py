"""Nearest neighbours by shifted Hilbert orderings.

Each of CURVES orderings projects the vectors on DIMS random orthonormal directions, shifts them,
and sorts all rows by their place on a Hilbert curve through the grid of the projection.  Spark
range-partitions the orderings; a query looks at the WINDOW rows before and after its own place in
each of them, and what the orderings find is merged and ranked by exact distance.

On vectors without structure no window of fixed size holds nine of ten neighbours, so an exact
check follows (``exact=True``): the rows of the first ordering lie in blocks with bounding boxes of
their projections.  A distance in the projection is never larger than the true one, so a block
whose box is farther from a query than its tenth candidate is passed over; the others are read.
Queries go to the blocks ``QUERY_BLOCK`` at a time.  With it the result is exact (recall 1); without it
the windows alone answer.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null
or non-finite components take no part; rows with equal vec_id count once, at the nearest;
ties go to the smaller vec_id; fewer candidates than k give all, but for rows farther than 1e150, whose
squares are at the end of what doubles hold; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CURVES, DIMS, GRID_BITS = 4, 8, 7
WINDOW, BLOCK, QUERY_BLOCK = 256, 1024, 20_000
#: Hits that a task holds before it keeps the k nearest ids of each query.
HELD = 200_000
FOUND = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of grid cells (Skilling's published transform, all rows at once)."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            x[0] = np.where(on, x[0] ^ p, x[0])
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def directions(dim: int, seed: int = 11) -> np.ndarray:
    """CURVES x dim x DIMS, each with orthonormal columns."""
    random = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(random.standard_normal((dim, dim)))[0][:, : min(DIMS, dim)] for _ in range(CURVES)])


def shifts(seed: int = 12) -> np.ndarray:
    return np.random.default_rng(seed).random((CURVES, DIMS))


def places(vectors: np.ndarray, curve: int, turn: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hilbert places of vectors; the grid is twice as wide as the data, which the shift moves in it."""
    p = vectors @ turn[curve]
    width = np.maximum(high[curve] - low[curve], 1e-12)
    cell = ((p - low[curve]) / width + shifts()[curve][: p.shape[1]]) / 2 * (1 << GRID_BITS)
    return hilbert(np.clip(cell, 0, (1 << GRID_BITS) - 1).astype(np.int64), GRID_BITS)


def exact_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component on."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = q[:, j] - x[:, j]
        total += d * d
    return np.sqrt(total)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding) that take part, and their length."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(ok, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = most["n"] if most else 0
    return rows.where(F.size("embedding") == dim), dim


def _bounds(rows: DataFrame, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest projections; a row a task reaches the driver."""

    def run(batches):
        low = high = None
        for b in batches:
            if b.num_rows:
                p = np.einsum("nd,cdk->cnk", _matrix(b.column(0)), turn)
                low = p.min(1) if low is None else np.minimum(low, p.min(1))
                high = p.max(1) if high is None else np.maximum(high, p.max(1))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"low": [low.ravel().tolist()], "high": [high.ravel().tolist()]})

    found = rows.select("embedding").transform(common.arrow, run, "low array<double>, high array<double>").collect()
    shape = (CURVES, turn.shape[2])
    return np.min([r.low for r in found], axis=0).reshape(shape), np.max([r.high for r in found], axis=0).reshape(shape)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k least (score, vec_id) of each query; an id counts once, at its least score."""
    order = np.lexsort((score, vec, query))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(query[order]) != 0) | (np.diff(vec[order]) != 0)
    once = order[new]
    order = once[np.lexsort((vec[once], score[once], query[once]))]
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def _ordered(rows: DataFrame, turn: np.ndarray, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Every row once in every ordering, range-partitioned and sorted by place."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1))
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(places(v, c, turn, low, high)), b.column(0), b.column(1)], ["curve", "place", "vec_id", "embedding"])

    return rows.transform(common.arrow, run, "curve int, place long, vec_id long, embedding array<double>").repartitionByRange("curve", "place", "vec_id").sortWithinPartitions("curve", "place", "vec_id")


def _windows(ordered: DataFrame, every: int, k: int, window: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest rows in each query's windows."""

    def found(curve, ids, v, first, last):
        """Queries at first .. last - 1 of what is held."""
        at = first + np.flatnonzero(ids[first:last] % every == 0)
        q, x = [], []
        for p in at:
            near = np.arange(max(0, p - window), min(len(ids), p + window + 1))
            near = near[(ids[near] != ids[p]) & (curve[near] == curve[p])]
            q.append(np.full(len(near), p))
            x.append(near)
        if not q:
            return None
        q, x = np.concatenate(q), np.concatenate(x)
        d = exact_distances(v[q], v[x])
        # by place: a query that stands in several orderings has candidates of its own in each
        best = _best(q, ids[x], d, k)
        return pa.RecordBatch.from_arrays([pa.array(ids[q[best]]), pa.array(ids[x[best]]), pa.array(d[best])], ["query_id", "vec_id", "score"])

    def run(batches):
        curve, ids, v, done = np.zeros(0, int), np.zeros(0, np.int64), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            curve, ids = np.concatenate([curve, b.column(0).to_numpy()]), np.concatenate([ids, b.column(2).to_numpy()])
            new = _matrix(b.column(3))
            v = new if v is None else np.concatenate([v, new])
            ready = max(done, len(ids) - window)
            if (out := found(curve, ids, v, done, ready)) is not None:
                yield out
            drop = max(0, ready - window)
            curve, ids, v, done = curve[drop:], ids[drop:], v[drop:], ready - drop
        if v is not None and (out := found(curve, ids, v, done, len(ids))) is not None:
            yield out

    return ordered.transform(common.arrow, run, FOUND)


def _blocks(ordered: DataFrame, turn: np.ndarray) -> DataFrame:
    """The first ordering in blocks: ids, vectors, and the bounding box of their projections."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                v = _matrix(part.column(3))
                p = v @ turn[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(2).to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()]), pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64()))],
                    ["ids", "vectors", "low", "high"],
                )

    return ordered.where("curve = 0").transform(common.arrow, run, "ids array<long>, vectors binary, low array<double>, high array<double>")


def _checked(blocks: DataFrame, queries: list[tuple], turn: np.ndarray, dim: int, k: int, hold: int = HELD) -> DataFrame:
    """Rows of all blocks that are no farther from a query than its farthest candidate."""
    ids = np.array([q[0] for q in queries], np.int64)
    shared = blocks.sparkSession.sparkContext.broadcast((ids, np.array([q[1] for q in queries], np.float64), np.array([q[2] for q in queries], np.float64)))

    def run(batches):
        qid, qv, reach = shared.value
        reach = reach.copy()
        p, own = qv @ turn[0], (qv * qv).sum(1)
        slack = 1e-9 * (1 + own)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for b in batches:
            for ids, raw, low, high in zip(*(b.column(i) for i in range(4)), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, dim)
                vec = ids.values.to_numpy()
                box = np.maximum(np.maximum(low.values.to_numpy() - p, p - high.values.to_numpy()), 0)
                near = np.flatnonzero((box * box).sum(1) <= reach**2 + slack)
                for i in range(0, len(near), 512):
                    some = near[i : i + 512]
                    d2 = own[some][:, None] + (x * x).sum(1) - 2 * (qv[some] @ x.T)
                    r, c = np.nonzero(d2 <= (reach[some] ** 2 + slack[some])[:, None])
                    r = some[r]
                    other = qid[r] != vec[c]
                    r, c = r[other], c[other]
                    d = exact_distances(qv[r], x[c])
                    ok = d <= reach[r]
                    held = [np.concatenate([h, n]) for h, n in zip(held, (r[ok], vec[c[ok]], d[ok]), strict=True)]
                if len(held[0]) > hold:
                    best = _best(*held, k)
                    held = [h[best] for h in held]
        if len(held[0]):
            q, vec, score = held
            best = _best(q, vec, score, k)
            yield pa.RecordBatch.from_arrays([pa.array(qid[q[best]]), pa.array(vec[best]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    return blocks.transform(common.arrow, run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", window: int = WINDOW, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score for the queries: rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    rows, dim = valid_vectors(rows, id_col, vec_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scratch = common.Scratch(spark, "neighbours")
    turn = directions(dim)
    low, high = _bounds(rows, turn)
    ordered = scratch.keep(_ordered(rows, turn, low, high), "ordered")
    # the written parts are the partitions in order: each is read as one or more runs of consecutive rows
    found = scratch.keep(_top(_windows(ordered, every, k, window), k), "windows")
    if not exact:
        return found
    blocks = scratch.keep(_blocks(ordered, turn), "blocks")
    reach = found.groupBy("query_id").agg(F.max("score").alias("reach"), F.count("*").alias("n"))
    queries = rows.where(F.col("vec_id") % every == 0).join(reach, rows["vec_id"] == reach["query_id"], "left")
    queries = queries.select("vec_id", "embedding", F.when(F.col("n") >= k, F.col("reach")).otherwise(F.lit(1e150)).alias("reach"))
    parts, held = [found.select("query_id", "vec_id", "score")], []

    def pass_over():
        parts.append(scratch.keep(_checked(blocks, held, turn, dim, k), f"pass{len(parts)}"))
        held.clear()

    for q in queries.orderBy("vec_id").toLocalIterator():
        held.append(tuple(q))
        if len(held) == QUERY_BLOCK:
            pass_over()
    if held:
        pass_over()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _top(out, k)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

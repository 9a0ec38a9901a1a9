"""Quality by ordinal cumulative-link regression on graded ratings.

Grades run from 0 (toxic) over 1 (poor) to 2 (fine).  A text has hashed features: which words it
holds (ASCII case and punctuation aside) and marks of its style (shares of capitals, symbols, repeated
words and so on over fixed steps).  One weight vector w serves all grades: with s = w.x and ordered thresholds
t0 < t1, P(grade <= k) = 1 / (1 + exp(s - t_k)).  Weights are fitted by proximal AdaGrad with an L1
penalty, so that words without evidence weigh nothing, however long a text is.

Only the fit sees a sample: ``sample_rows`` labelled rows at most, those first by a hash of doc_id.
Every document is scored, over its whole text.

Defined cases: a text without words, and a null text, has no evidence and is kept, with null
scores; repeated labels of a document count once, at the lowest grade; of labelled rows with equal
doc_id the least text is fitted; labels with nulls are left out; without labels of two grades nothing is learned and every score is null; rows with equal
doc_id each give a row; an empty table gives no rows; other columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .decontaminate import FOLD

BITS = 20
GRADES = 3
SAMPLE_ROWS = 15_000
U = np.uint64
STEPS = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8])
NOT_WORD = np.array([b == 32 for b in FOLD])


def _classes() -> np.ndarray:
    """Style classes of bytes, one row each: capitals, digits, longer characters, bars, marks, other symbols."""
    b = np.arange(256)
    upper, digit, high, bar = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), b >= 128, b == 124
    mark = np.isin(b, list(b".,;:'\"-()?"))
    letter = (b >= 97) & (b <= 122)
    other = ~(upper | digit | high | bar | mark | letter | (b <= 32))
    return np.stack([upper, digit, high, bar, mark, other])


CLASSES = _classes()
FOLDED = np.frombuffer(FOLD, np.uint8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of a group of texts with each word of each text, in order; and how many words each has."""
    buf, at = words.joined(texts)
    first, last = words.spans(buf, NOT_WORD)
    doc_at = np.searchsorted(first, at)
    n = np.diff(doc_at)
    text = np.repeat(np.arange(len(texts)), n)
    bucket = (words.span_hashes(FOLDED[buf], first, last) >> U(64 - BITS)).astype(np.int64)
    chars = np.maximum(np.diff(at) - 1, 1)
    more_text, more_bucket = [], []
    # style: bytes of each class, words that repeat the word before, words that repeat any in the text
    again = np.zeros(len(text) + 1, np.int64)
    again[2:] = np.cumsum((bucket[1:] == bucket[:-1]) & (text[1:] == text[:-1])) if len(text) > 1 else again[2:]
    different = np.bincount(distinct(text, bucket)[0], minlength=len(texts))
    counted = np.maximum(n, 1)
    shares = [np.diff(np.concatenate([[0], np.cumsum(c[buf])])[at]) / chars for c in CLASSES]
    shares += [np.diff(again[doc_at]) / counted, np.where(n >= 20, 1 - different / counted, 0)]
    for c, share in enumerate(shares):
        k = np.where(n > 0, np.searchsorted(STEPS, share, "right"), 0)
        t = np.repeat(np.arange(len(texts)), k)
        step = np.arange(len(t)) - np.repeat(np.cumsum(k) - k, k)
        more_text.append(t)
        more_bucket.append((words.mix((step + 1000 * (c + 1)).astype(U)) >> U(64 - BITS)).astype(np.int64))
    return np.concatenate([text, *more_text]), np.concatenate([bucket, *more_bucket]), n


def distinct(text: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.unique(text << BITS | bucket)
    return found >> BITS, found & ((1 << BITS) - 1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, a column each."""
        return _sigmoid(score[:, None] - self.thresholds)

    def scores(self, text: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        some = self.weights[bucket] != 0
        text, bucket = distinct(text[some], bucket[some])
        return np.bincount(text, self.weights[bucket], texts)


def fit(rows: list[np.ndarray], grade: np.ndarray, steps: int = 1200, rate: float = 0.3, penalty: float = 0.06, batch: int = 256, least_df: int = 4, seed: int = 7) -> CumulativeLink | None:
    """Rows of distinct buckets with their grades.  Buckets of fewer than ``least_df`` rows take no part."""
    if len(np.unique(grade)) < 2:
        return None
    size = 1 << BITS
    df = np.bincount(np.concatenate(rows), minlength=size) if rows else np.zeros(size)
    rows = [r[df[r] >= least_df] for r in rows]
    w, seen = np.zeros(size), np.full(size, 1e-8)
    # thresholds at the observed shares; t1 = t0 + exp(gap) keeps them in order
    below = np.clip([(grade <= k).mean() for k in range(GRADES - 1)], 0.01, 0.99)
    start = np.log(below / (1 - below))
    cut = np.array([start[0], np.log(max(start[1] - start[0], 0.1))])
    seen_cut = np.full(2, 1e-2)
    # noise in a gradient falls with the root of the rows it is summed over, and so does the penalty
    l1 = penalty / np.sqrt(len(rows))
    random = np.random.default_rng(seed)
    epochs = max(1, -(-steps * batch // len(rows)))
    for epoch in range(epochs):
        order, step = random.permutation(len(rows)), rate / (1 + 4.0 * epoch / epochs)
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            y, index = grade[part], [rows[k] for k in part]
            flat, owner = np.concatenate(index), np.repeat(np.arange(len(part)), [len(x) for x in index])
            s = np.bincount(owner, w[flat], len(part))
            t0, t1 = cut[0], cut[0] + np.exp(cut[1])
            a, b = _sigmoid(t0 - s), _sigmoid(t1 - s)
            p = np.maximum(np.select([y == 0, y == 1], [a, b - a], 1 - b), 1e-9)
            da, db = a * (1 - a), b * (1 - b)
            g0 = np.select([y == 0, y == 1], [-da / p, da / p], 0.0)
            g1 = np.select([y == 0, y == 1], [0.0, -db / p], db / p)
            gs = -(g0 + g1) / len(part)
            grad_cut = np.array([(g0 + g1).mean(), g1.mean() * np.exp(cut[1])])
            seen_cut += grad_cut**2
            cut -= step * grad_cut / np.sqrt(seen_cut)
            touched, where = np.unique(flat, return_inverse=True)
            g = np.bincount(where, gs[owner], len(touched))
            seen[touched] += g * g
            pace = step / np.sqrt(seen[touched])
            new = w[touched] - pace * g
            w[touched] = np.sign(new) * np.maximum(np.abs(new) - pace * l1, 0)
    return CumulativeLink(w, np.array([cut[0], cut[0] + np.exp(cut[1])]))


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic labels."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> CumulativeLink | None:
    """Fit on a bounded sample of the labelled documents."""

    def run(batches):
        common.held("quality")
        for b in common.slices(batches):
            texts, grade = _texts(b.column(1)), b.column(2).to_numpy()
            for i, j in words.groups(texts):
                text, bucket, n = features(texts[i:j])
                text, bucket = distinct(text, bucket)
                ends = np.searchsorted(text, np.arange(j - i + 1))
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(grade[i:j], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket.astype(np.int32)))],
                    ["doc_id", "grade", "buckets"],
                )
                yield out.filter(pa.array(n > 0))

    # sample_rows rows of 16 bytes at most
    sample = F.broadcast(grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(sample, "doc_id")
    # as many rows as the sample has reach the driver, however often a doc_id stands in docs
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade")).transform(common.arrow, run, "doc_id long, grade int, buckets array<int>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    lists = rows.column("buckets").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    return fit([flat[at[i] : at[i + 1]] for i in order], rows.column("grade").to_numpy()[order])


def _judged(texts: list[bytes], model: CumulativeLink | None, least_tail: float):
    """(expected grade, P(grade >= 2), known, keep) of texts."""
    grade, tail, known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if model is not None:
        for i, j in words.groups(texts):
            text, bucket, n = features(texts[i:j])
            p = model.tails(model.scores(text, bucket, j - i))
            grade[i:j], tail[i:j], known[i:j] = p.sum(1), p[:, -1], n > 0
    return grade, tail, known, ~known | (tail >= least_tail)


def score_documents(docs: DataFrame, model: CumulativeLink | None, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade), keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        common.held("quality")
        for b in common.slices(batches):
            grade, tail, known, keep = _judged(_texts(b.column(1)), shared.value, least_tail)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(grade, 6), mask=~known), pa.array(np.round(tail, 6), mask=~known), pa.array(keep)], ["doc_id", "expected_grade", "tail_probability", "keep"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return docs.transform(common.arrow, run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def keep_good(docs: DataFrame, model: CumulativeLink | None, least_tail: float = 0.5) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        common.held("quality")
        for b in common.slices(batches):
            yield b.filter(pa.array(_judged(_texts(b.column(at)), shared.value, least_tail)[3]))

    return docs.transform(common.arrow, run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, common.table(spark, sf_dir, "labels")))

"""Ranked lexical search by Fagin's threshold algorithm.

Terms are runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case.  With N
documents that have terms, L terms in all, n in a document, a term's document frequency df and its
occurrences tf in a document (all counted over the whole table):

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))        m = 25 + (75 n N) div L
    impact = (10**9 tf) div (1000 tf + 8 m)           score = sum of w * impact over the item's terms, repeats included

*Index.*  One pass over the texts writes the forward index: for each document its number of terms, and
the ids and counts of those terms that an item holds.  N, L and df are aggregates over it.

*Search.*  A task reads its part of the forward index in segments of at most ``SEGMENT`` entries and
sorts a segment's entries by term and falling impact: the inverted lists.  For an item the lists of its terms
are read in turn, to the same depth in each; a document that is met is scored at once from the
forward index.  The threshold is the score of a document that stands in every list at the depth
read (0 for a list read to its end), so no unmet document scores more.  Reading stops when the threshold is strictly
below the k-th best score of the segments read so far: documents that tie at the k-th place are all met.  Steps of
depth double.  Each task gives at most k documents an item, and two windows, the first over parts of
an item, give the ranks.

Items are a stated set of queries.  They are read in blocks of at most ``BLOCK_TERMS`` terms (those of
50,000 items and more), each with an index of its own; a block is sent to all tasks.

Defined cases: a null text has no terms; documents without a term of the item aren't ranked, nor
those of score 0; an item without terms has no rows; items of equal id and text count once, items of equal id
and different texts are ranked each; rows with equal doc_id are ranked each; among equal scores a null
doc_id comes last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

#: A-Z to a-z; what is no digit, letter or part of a longer UTF-8 character to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms of the items of a block; a Python worker holds some 150 bytes for each.
BLOCK_TERMS = 1_000_000
#: Entries (document, term) of a segment; some 60 bytes each.
SEGMENT = 2_000_000
#: Entries read from each list in the first step.
FIRST_DEPTH = 16
PARTS = 32


@dataclass
class Items:
    """A block of items: their ids, and for each the ids of its distinct terms and how often it holds them."""

    names: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: list[bytes]


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def item_blocks(items: DataFrame, block_terms: int) -> Iterator[Items]:
    """The items in blocks of at most ``block_terms`` distinct terms (one item at least); one block is held at a time."""
    vocabulary: dict[bytes, int] = {}
    block = Items([], [], [], [])
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for name, text in rows.toLocalIterator():
        counts = Counter(terms_of(text))
        if block.names and len(vocabulary) + len(counts.keys() - vocabulary.keys()) > block_terms:
            block.vocabulary = list(vocabulary)
            yield block
            vocabulary, block = {}, Items([], [], [], [])
        if counts:
            block.names.append(name)
            block.terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64))
            block.times.append(np.array(list(counts.values()), np.int64))
    if block.names:
        block.vocabulary = list(vocabulary)
        yield block


class Lookup:
    """Ids of terms (-1: no item holds it), remembered by their bytes."""

    def __init__(self, vocabulary: list[bytes]):
        self.ids = {t: k for k, t in enumerate(vocabulary)}
        self.memo = words.Memo(np.int32)

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.ids.get(t, -1) for t in new], np.int32), np.ones(len(new), np.int64)

    def entries(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text; then, by text and term, how many different known terms it has, their ids and counts."""
        buf, at = words.joined([t.translate(FOLD) for t in texts])
        first, last = words.spans(buf)
        n = np.diff(np.searchsorted(first, at))
        ids, _ = self.memo.values(buf, first, last, self._learn)
        text, known = np.repeat(np.arange(len(texts)), n), ids >= 0
        base = len(self.ids) + 1
        key, tf = np.unique(text[known] * base + ids[known], return_counts=True)
        return n, np.bincount(key // base, minlength=len(texts)), key % base, tf


def forward_index(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n, terms, counts of every document; ``shared``: a broadcast ``Items``."""

    name = uuid.uuid4().hex

    def run(batches):
        lookup = common.held("ranked", name, lambda: Lookup(shared.value.vocabulary))
        for b in common.slices(batches):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in words.groups(texts):
                n, size, ids, tf = lookup.entries(texts[i:j])
                at = np.zeros(j - i + 1, np.int32)
                np.cumsum(size, out=at[1:])
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, pa.int32())) for x in (ids, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    schema = "doc_id long, n long, terms array<int>, counts array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(common.arrow, run, schema)


class Segment:
    """Impact-sorted lists and forward index of some documents."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, n: np.ndarray, at: np.ndarray, terms: np.ndarray, tf: np.ndarray, docs: int, length: int):
        self.ids, self.none, self.at, self.terms = ids, none, at, terms
        m = 25 + (75 * n * docs) // length
        of = np.repeat(np.arange(len(ids)), np.diff(at))
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[of])
        order = np.lexsort((-self.impact, terms))
        self.by_impact, self.list_doc = self.impact[order], of[order]
        self.list_term = terms[order]
        self.seen = np.zeros(len(ids), bool)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Random accesses: whole scores of documents from their forward entries."""
        first, size = self.at[docs], self.at[docs + 1] - self.at[docs]
        part = words.gather(self.impact, first, size) * weight[words.gather(self.terms, first, size)]
        return np.add.reduceat(part, np.cumsum(size) - size)  # a met document has an entry

    def search(self, terms: np.ndarray, worth: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Read the lists of ``terms`` (``worth``: weight times repeats, ``weight``: the same by term id) until ``best`` can't change."""
        start, stop = (np.searchsorted(self.list_term, terms, side) for side in ("left", "right"))
        met, depth, step = [], 0, FIRST_DEPTH
        while True:
            here = np.minimum(np.maximum(stop - start - depth, 0), step)
            if not here.any():
                break
            docs = np.unique(words.gather(self.list_doc, np.minimum(start + depth, stop), here))
            docs = docs[~self.seen[docs]]
            if len(docs):
                self.seen[docs] = True
                met.append(docs)
                best.add(self.scores(docs, weight), self.ids[docs], self.none[docs])
            depth, step = depth + step, depth + step
            open_ = start + depth < stop
            threshold = int((worth[open_] * self.by_impact[start[open_] + depth - 1]).sum())
            if threshold < max(best.kth, 1):
                break
        for docs in met:
            self.seen[docs] = False


class Best:
    """The k best documents of an item so far: highest scores first, then the least doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.kth = k, 0
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        keep = score >= max(self.kth, 1)
        score, ids, none = np.concatenate([self.score, score[keep]]), np.concatenate([self.id, ids[keep]]), np.concatenate([self.none, none[keep]])
        first = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[first], ids[first], none[first]
        if len(first) == self.k:
            self.kth = int(self.score[-1])


def _segments(batches, size: int) -> Iterator[pa.Table]:
    """Rows of the forward index in segments of about ``size`` entries."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += len(b.column(2).flatten()) + b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def best_of_tasks(index: DataFrame, shared, k: int, segment: int) -> DataFrame:
    """item, doc_id, score: at most k documents an item from each task; ``shared``: (Items, weights by term id, N, L)."""

    def run(batches):
        items, w, n_docs, length = shared.value
        best = [Best(k) for _ in items.names]
        weight = np.zeros(len(w), np.int64)
        for t in _segments(batches, segment):
            t = t.combine_chunks()
            terms, counts = (t.column(c).chunk(0) for c in ("terms", "counts"))
            at = terms.offsets.to_numpy().astype(np.int64)
            ids = t.column("doc_id").chunk(0)
            s = Segment(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), t.column("n").chunk(0).to_numpy(), at - at[0], *(x.flatten().to_numpy().astype(np.int64) for x in (terms, counts)), n_docs, length)
            for which, times, b in zip(items.terms, items.times, best, strict=True):
                worth = w[which] * times
                weight[which] = worth
                s.search(which, worth, weight, b)
                weight[which] = 0
        for i, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i), pa.int32()), pa.array(b.id, pa.int64(), mask=b.none), pa.array(b.score, pa.int64())], ["item", "doc_id", "score"])

    return index.transform(common.arrow, run, "item int, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score; parts of an item are cut to k rows before they meet."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, segment: int = SEGMENT) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark, parts = docs.sparkSession, []
    scratch = common.Scratch(spark, "ranked")
    for at, block in enumerate(item_blocks(items, block_terms)):
        shared = spark.sparkContext.broadcast(block)
        index = scratch.keep(forward_index(docs, shared), f"index{at}")
        n_docs, length = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        # at most BLOCK_TERMS rows
        df = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        held = np.zeros(len(block.vocabulary), np.int64)
        held[df.column("term").to_numpy()] = df.column("count").to_numpy()
        weigh = functools.cache(lambda x, n=n_docs: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))))
        w = np.array([weigh(x) for x in held.tolist()], np.int64)
        names = spark.createDataFrame(list(enumerate(block.names)), "item int, item_id long")
        shared.destroy()
        block.vocabulary = []
        if n_docs:
            found = best_of_tasks(index, spark.sparkContext.broadcast((block, w, n_docs, length)), k, segment)
            parts.append(ranked(found, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, parts)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (SELECT row, doc_id, unnest(w) AS term, len(w) AS n FROM (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
tf AS (SELECT row, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*) AS tf FROM words GROUP BY row, term),
size AS (SELECT count(DISTINCT row)::BIGINT AS nd, sum(tf)::BIGINT AS l FROM tf),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
items AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM (
  SELECT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM items) GROUP BY item, term),
scored AS (SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
  sum(times * CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN size GROUP BY item, row),
placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""

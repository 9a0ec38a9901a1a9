"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Text and benchmark lose ASCII case and fall into words (runs of digits, letters and bytes from
0x80).  A pattern is ``window`` consecutive words of an item, or the whole item where it has fewer.
Patterns of one length m share a search: a table from blocks of two words to shifts says how far
the window may move on without missing a pattern (m - 1 for a block that no pattern holds); where the
shift is 0, the patterns that end in this block and begin with the window's first word are compared
with the text word by word.

The benchmark is read in blocks of at most ``block_words`` pattern words, one at a time, each a search
of its own over all documents; with more than one block, what they hit is joined by a key of the row.

Defined cases: a null or empty text has no words and is clean; an item without words has no
pattern; items with equal id count once; an item without id counts under the empty string; rows
with equal doc_id each give a row (a key of their place in the input keeps them apart); an empty
table gives no rows, an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A-Z to a-z; what is no digit, letter or part of a longer UTF-8 character to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Words in the patterns of a block; a Python worker holds some 80 bytes for each.
BLOCK_WORDS = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Occurrences of patterns that all have ``m`` words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], m: int):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for p, items in patterns.items():
            for q in range(self.block, m + 1):
                b = p[q - self.block : q]
                self.shift[b] = min(self.shift.get(b, self.default), m - q)
            self.ends.setdefault(p[m - self.block :], {}).setdefault(p[0], []).append((list(p), items))

    def search(self, words: list[bytes]) -> Iterable[tuple[int, set[str]]]:
        """(start, items) of each occurrence."""
        m, shift, default, n, i = self.m, self.shift.get, self.default, len(words), self.m - 1
        if self.block == 1:
            for i, w in enumerate(words):
                if (w,) in self.ends:
                    for _, items in self.ends[(w,)][w]:
                        yield i, items
            return
        while i < n:
            step = shift((words[i - 1], words[i]), default)
            if step:
                i += step
                continue
            first = i - m + 1
            for pattern, items in self.ends[(words[i - 1], words[i])].get(words[first], ()):
                if words[first : i + 1] == pattern:
                    yield first, items
            i += 1


def searches(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), set()).add(item)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def hits(found: list[WuManber], words: list[bytes]) -> tuple[bytearray, set[str]]:
    """Which words are in an occurrence, and the items that occur."""
    mask, items = bytearray(len(words)), set()
    for s in found:
        one = b"\1" * s.m
        for first, which in s.search(words):
            mask[first : first + s.m] = one
            items |= which
    return mask, items


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _built(shared, window: int) -> list[WuManber]:
    """The searches for a broadcast block; a Python worker keeps those of one block."""
    return common.held("decontaminate", hash((window, tuple(shared.value))), lambda: searches(shared.value, window))


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks whose patterns have at most ``block_words`` words (one item at least); one block is held at a time."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        raw = (text or "").encode()
        size = window * len(words_of(raw))
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((item or "", raw))
        n += size
    yield block


def _one_or_more(blocks: Iterator[list]) -> tuple[list | None, Iterator[list]]:
    """The only block, or None and all of them."""
    first = next(blocks)
    second = next(blocks, None)
    return (first, iter([])) if second is None else (None, itertools.chain([first, second], blocks))


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    spark = docs.sparkSession
    only, blocks = _one_or_more(item_blocks(benchmark, window, block_words))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def summary(doc, n, hit, items):
        names = [",".join(sorted(i)).encode() for i in items]
        return pa.RecordBatch.from_arrays(
            [doc, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([sha256(x).hexdigest() for x in names]), pa.array([contaminated(h, k) for h, k in zip(hit, n, strict=True)])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    if only is not None:
        shared = spark.sparkContext.broadcast(only)

        def run(batches):
            found = _built(shared, window)
            for b in common.slices(batches):
                n, hit, items = [], [], []
                for t in _texts(b.column(1)):
                    words = words_of(t)
                    mask, which = hits(found, words)
                    n.append(len(words))
                    hit.append(mask.count(1))
                    items.append(which)
                yield summary(b.column(0), n, hit, items)

        return docs.transform(common.arrow, run, schema)

    scratch = common.Scratch(spark, "decontaminate")
    docs = scratch.keep(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    return _over_blocks(docs, blocks, window, scratch).drop("row")


def _over_blocks(docs: DataFrame, blocks: Iterator[list[tuple[str, bytes]]], window: int, scratch: common.Scratch) -> DataFrame:
    """What ``find_hits`` gives, and row, of (doc_id, text, row): each block gives the places it hits, joined by the row's key."""
    spark, parts = docs.sparkSession, []
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            found = _built(shared, window)
            for b in common.slices(batches):
                n, at, items = [], [], []
                for t in _texts(b.column(1)):
                    words = words_of(t)
                    mask, which = hits(found, words)
                    n.append(len(words))
                    at.append(np.flatnonzero(np.frombuffer(mask, np.uint8)).tolist())
                    items.append(sorted(which))
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "at", "items"])

        parts.append(scratch.keep(docs.transform(common.arrow, run, "row long, doc_id long, n_words long, at array<long>, items array<string>"), f"block{k}"))
        shared.destroy()
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    joined = everything.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.size("at").cast("long")
    return joined.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    spark = docs.sparkSession
    only, blocks = _one_or_more(item_blocks(benchmark, window, block_words))
    if only is None:
        # rows are judged by a key of their own: a doc_id may be null or stand twice
        scratch, key = common.Scratch(spark, "decontaminate"), "row_key"
        while key in {c.lower() for c in docs.columns}:
            key += "_"
        rows = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
        judged = _over_blocks(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(key).alias("row")), blocks, window, scratch)
        return rows.join(judged.where("contaminated").select(F.col("row").alias(key)), key, "left_anti").select(docs.columns)
    shared, at = spark.sparkContext.broadcast(only), docs.columns.index("text")

    def run(batches):
        found = _built(shared, window)
        for b in common.slices(batches):
            keep = []
            for t in _texts(b.column(at)):
                words = words_of(t)
                keep.append(not contaminated(hits(found, words)[0].count(1), len(words)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.transform(common.arrow, run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM sized, unnest(range(1, len(w) - m + 2)) AS t(i)),
lengths AS (SELECT DISTINCT m FROM patterns),
windows AS (SELECT row, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM d CROSS JOIN lengths, unnest(range(1, len(w) - m + 2)) AS t(i)),
found AS (SELECT row, windows.m AS m, i, item FROM windows JOIN patterns ON windows.m = patterns.m AND windows.g = patterns.g),
words AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + m)) AS p FROM found) GROUP BY 1),
items AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT row, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""

"""Removal of long repeated word runs by recompression.

A text is a string of words.  A round names blocks of it: equal neighbours form a run, and of two
neighbours of which the first falls into the left and the second into the right half of the
alphabet (a bit of the name's hash) a pair.  Where a block ends depends on the two symbols at its end
alone, so equal substrings get equal blocks but for a few at their rims.  Rounds repeat on the
names; symbols grow by a third a round.  A task needs no name table to parse: a name is a hash of the
block's words, the same in every text on every executor.

What is acted upon is named globally, in Spark, by 128 bits of blake2b of the words themselves:

1. High symbols.  The blocks of round HIGH (some 20 words) of at least a window, and each text's
   root, are grouped over all documents.  A symbol that starts in a smaller document goes whole;
   the windows inside it are dealt with by that.  A whole copy goes by its root, and all of its
   blocks occur in its original.
2. Low symbols.  Every window that no such symbol holds has an anchor: of the blocks of round LOW
   whose neighbours lie inside the window too, the one with the least hash.  It is the same in
   whatever text the window stands (a window without such a block, inside a run say, is its own
   anchor).  Anchors found in two documents or more are shared; only windows under these go on.
3. Windows under shared anchors are named and grouped; those that start in a smaller document go.

Counts come before joins, and the tables joined are written first: both sides are then plain
shuffles, whose large partitions (a passage in very many documents) Spark may split.

Defined cases: a null text has no words; fewer than 13 words are never removed; a null doc_id
compares with nothing and keeps all; rows with equal doc_id don't remove from each other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

U = np.uint64
LOW, HIGH = 2, 11
ROOT, BLOCK, WINDOW = 0, 1, 2


def _joined(names: np.ndarray, text: np.ndarray, number: int) -> np.ndarray:
    """joined[i]: symbol i stands in one block with symbol i - 1."""
    left = (words.mix(names + U(number * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & U(1)).astype(bool)
    out = np.zeros(len(names), bool)
    out[1:] = (text[1:] == text[:-1]) & ((names[1:] == names[:-1]) | (left[:-1] & ~left[1:]))
    return out


class Blocks:
    """The symbols of one round: name, first word and end, and the words that fix the block (its context)."""

    def __init__(self, name, first, last, since, until):
        self.name, self.first, self.last, self.since, self.until = name, first, last, since, until


def rounds(w: words.Words, sums: np.ndarray) -> Iterator[Blocks]:
    """The symbols of a group of texts after each round in turn."""
    text = np.repeat(np.arange(len(w.doc_at) - 1), w.counts())
    begin, end = w.doc_at[:-1], w.doc_at[1:]
    names, number = w.hash, 0
    first, last = np.arange(len(names)), np.arange(1, len(names) + 1)
    # a word is fixed by itself; a block by itself and by the symbols beside it
    since, until = first, last
    while True:
        number += 1
        at = np.flatnonzero(~_joined(names, text, number))
        stop = np.append(at[1:], len(names))
        if not len(names):
            at = stop = np.zeros(0, np.int64)
        before, after = np.maximum(at - 1, 0), np.minimum(stop, len(names) - 1)
        no_before = (at == 0) | (text[before] != text[at])
        no_after = (stop == len(names)) | (text[after] != text[at])
        # at the rim of a text nothing can be told from within: the context reaches outside
        since = np.where(no_before, begin[text[at]] - 1, since[before])
        until = np.where(no_after, end[text[at]] + 1, until[after])
        first, last, text = first[at], last[stop - 1], text[at]
        names = words.range_hashes(sums, first, last)
        yield Blocks(names, first, last, since, until)


class Parsed:
    """A group of texts with its windows, their anchors and the high blocks; texts in words with one space between them."""

    def __init__(self, texts: list[bytes], window: int):
        w = self.words = words.Words(texts)
        self.window, self.sums = window, words.prefix_sums(w.hash)
        self.raw = w.buf.tobytes()
        for number, found in enumerate(rounds(w, self.sums), 1):
            if number == LOW:
                self.low = found
            if number == HIGH:
                break
        some = found.last - found.first >= window
        #: high blocks of a window or more
        self.first, self.last = found.first[some], found.last[some]
        n = np.maximum(w.counts() - window + 1, 0)
        #: text and first word of each window
        self.text = np.repeat(np.arange(len(n)), n)
        self.at = np.repeat(w.doc_at[:-1] - (np.cumsum(n) - n), n) + np.arange(len(self.text))

    def names(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128 bits of a digest of the words first .. last - 1, a row each."""
        raw, a, b = self.raw, self.words.first[first].tolist(), self.words.last[last - 1].tolist()
        found = [blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(a, b, strict=True)]
        return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts of a window or more, and their names."""
        some = np.flatnonzero(self.words.counts() >= self.window)
        return some, self.names(self.words.doc_at[some], self.words.doc_at[some + 1])

    def owners(self) -> np.ndarray:
        """The high block that holds each window, -1 where none does."""
        if not len(self.first):
            return np.full(len(self.at), -1)
        block = np.searchsorted(self.first, self.at, "right") - 1
        return np.where((block >= 0) & (self.at + self.window <= self.last[block]), block, -1)

    def quick(self) -> np.ndarray:
        """A hash of each window, to find candidates by."""
        return words.range_hashes(self.sums, self.at, self.at + self.window)

    def anchors(self) -> np.ndarray:
        """The key of each window's anchor: a hash of the anchor's context."""
        at, window, low = self.at, self.window, self.low
        key = self.quick() ^ U(0xE7037ED1A0B428DB)
        n = len(low.name)
        if not len(at) or not n:
            return key
        # a block's rank: bits of its hash, then its place (of equal ones the first in the window counts)
        place = U((1 << n.bit_length()) - 1)
        rank = words.mix(low.name ^ U(0xA0761D6478BD642F)) & ~place | np.arange(n, dtype=U)
        # blocks least .. most - 1 have their context in the window: counts of contexts that begin before it and end by its end
        size = len(self.words.hash) + 2
        least = np.cumsum(np.bincount(low.since + 1, minlength=size))[at]
        most = np.cumsum(np.bincount(low.until, minlength=size))[at + window]
        # least ranks of 1, 2, 4, ... blocks from each on; two of these cover any range
        table = [rank]
        while 2 << len(table) - 1 <= window:
            step = 1 << len(table) - 1
            table.append(np.minimum(table[-1], np.append(table[-1][step:], np.full(min(step, n), ~U(0)))))
        some = np.flatnonzero(most > least)
        least, many = least[some], (most - least)[some]
        level = np.log2(np.arange(window + 2), where=np.arange(window + 2) > 0, out=np.zeros(window + 2)).astype(np.int64)[many]
        table = np.concatenate(table)
        best = np.minimum(table[level * n + least], table[level * n + least + many - (1 << level)]) & place
        context = words.range_hashes(self.sums, np.maximum(low.since, 0), np.minimum(low.until, len(self.words.hash)))
        key[some] = context[best.astype(np.int64)]
        return key


def _steps(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before them."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _among(own: np.ndarray, text: np.ndarray, listed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the texts' hashes are listed for the text they stand in."""
    own, listed = words.mix(own + words.mix(text.astype(U))), words.mix(listed + words.mix(owner.astype(U)))
    seen = np.zeros(1 << 20, bool)
    seen[listed >> U(44)] = True
    out = seen[own >> U(44)]
    maybe = np.flatnonzero(out)
    out[maybe] = np.isin(own[maybe], listed)
    return out


def _normal(column) -> list[bytes]:
    """Texts with one space between words."""
    return [b" ".join((t or b"").split()) for t in column.cast(pa.binary()).to_pylist()]


def _parsed(texts: list[bytes], window: int) -> Iterator[tuple[int, int, Parsed]]:
    for i, j in words.groups(texts):
        yield i, j, Parsed(texts[i:j], window)


SYMBOLS = "doc_id long, kind int, a long, b long, keys array<long>"


def _symbols(window: int):
    """Roots and high blocks with their names and the anchor keys of the windows that they hold (a root: that no block holds)."""

    def run(batches):
        common.held("repeats")
        for batch in common.slices(batches, 512):
            for i, j, p in _parsed(_normal(batch.column(1)), window):
                some, root = p.roots()
                if not len(some):
                    continue
                owner, key = p.owners(), p.anchors()
                # symbols in a row: roots first, then blocks
                place = np.full(j - i, -1)
                place[some] = np.arange(len(some))
                symbol = np.where(owner < 0, place[p.text], len(some) + owner)
                new = _steps(key, symbol)  # neighbours mostly share an anchor
                symbol, key = symbol[new], key[new]
                order = np.lexsort((key, symbol))
                symbol, key = symbol[order], key[order]
                new = _steps(key, symbol)
                symbol, key = symbol[new], key[new]
                n = len(some) + len(p.first)
                ends = np.searchsorted(symbol, np.arange(n + 1))
                name = np.concatenate([root, p.names(p.first, p.last)])
                text = np.concatenate([some, np.searchsorted(p.words.doc_at, p.first, "right") - 1])
                kind = np.repeat([ROOT, BLOCK], [len(some), len(p.first)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + text)), pa.array(kind), pa.array(name[:, 0]), pa.array(name[:, 1]), keys], ["doc_id", "kind", "a", "b", "keys"])

    return run


def _firsts(rows: DataFrame, *by: str) -> DataFrame:
    """(by, least) of what stands in two documents or more; least is the least document."""
    return rows.groupBy(*by).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document (and the kept words, if asked for)."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    known = docs.where("doc_id IS NOT NULL")

    # 1. high symbols
    symbols = scratch.keep(known.transform(common.arrow, _symbols(window), SYMBOLS), "symbols")
    first = scratch.keep(_firsts(symbols, "kind", "a", "b"), "first")
    met = symbols.join(first, ["kind", "a", "b"], "left").select("doc_id", "kind", "a", "b", (F.col("doc_id") > F.coalesce("least", "doc_id")).alias("gone"), "keys")
    kept = F.when(~F.col("gone"), F.col("keys")).alias("keys")
    met = scratch.keep(met.select("doc_id", *(F.when(F.col("gone"), F.col(c)).alias(c) for c in ("kind", "a", "b")), kept, "gone"), "met", "gone")
    scratch.drop("symbols", "first")

    # 2. low symbols
    keys = met.where("NOT gone").select("doc_id", F.explode("keys").alias("key"))
    shared = scratch.keep(_firsts(keys, "key").select("key"), "shared")
    lists = scratch.keep(keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "lists")
    scratch.drop("shared", "met/gone=false")

    # 3. windows
    def windows(batches):
        common.held("repeats")
        for batch in common.slices(batches, 512):
            lists = batch.column(2)
            for i, j, p in _parsed(_normal(batch.column(1)), window):
                part = lists.slice(i, j - i)
                wanted = part.flatten().to_numpy().view(U)
                owner = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
                key = p.anchors()
                new = np.flatnonzero(_steps(key, p.text))
                keep = np.repeat(_among(key[new], p.text[new], wanted, owner), np.diff(np.append(new, len(key))))
                text, at, quick = p.text[keep], p.at[keep], p.quick()[keep]
                name = p.names(at, at + window)
                # once a text
                one = np.lexsort((name[:, 1], name[:, 0], text))
                one = one[_steps(text[one], name[one, 0], name[one, 1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i + text[one])), pa.array((quick[one] >> U(32)).astype(np.uint32).view(np.int32)), pa.array(name[one, 0]), pa.array(name[one, 1])], ["doc_id", "quick", "a", "b"]
                )

    found = known.join(lists, "doc_id").select("doc_id", "text", "keys").transform(common.arrow, windows, "doc_id long, quick int, a long, b long")
    found = scratch.keep(found, "windows")
    first = scratch.keep(_firsts(found, "a", "b"), "first")
    later = found.join(first, ["a", "b"]).where("doc_id > least")
    gone = met.where("gone").select("doc_id", "kind", F.lit(0).alias("quick"), "a", "b").unionByName(later.select("doc_id", F.lit(WINDOW).alias("kind"), "quick", "a", "b"))
    gone = scratch.keep(gone.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("kind", "quick", "a", "b"))), "gone")
    scratch.drop("met", "lists", "windows", "first")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def finish(batches):
        common.held("repeats")
        for batch in common.slices(batches, 512):
            texts, marks = _normal(batch.column(1)), [None] * batch.num_rows
            some = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            listed = [batch.column(k).take(pa.array(some)) for k in range(2, 6)]
            for i, j, p in _parsed([texts[k] for k in some], window):
                part = [x.slice(i, j - i) for x in listed]
                for k, mark in enumerate(_marks(p, part)):
                    marks[some[i + k]] = mark
            n, gone, sha, kept = [], [], [], []
            for t, mark in zip(texts, marks, strict=True):
                count = t.count(b" ") + 1 if t else 0
                n.append(count)
                if mark is None:
                    gone.append(0)
                else:
                    gone.append(int(mark.sum()))
                    t = b" ".join([x for x, m in zip(t.split(b" "), mark.tolist(), strict=True) if not m])
                sha.append(sha256(t).hexdigest())
                if with_text:
                    kept.append(t.decode())
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(kept, pa.string())] if with_text else []), ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    columns = ["doc_id", "text", "kind", "quick", "a", "b"]
    lost = docs.where("doc_id IS NULL").select("doc_id", "text", *(F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("kind", "int"), ("quick", "int"), ("a", "long"), ("b", "long"))))
    return known.join(gone, "doc_id", "left").select(columns).unionByName(lost).transform(common.arrow, finish, schema)


def _marks(p: Parsed, listed: list) -> Iterator[np.ndarray]:
    """Of each text of a group, which words go: those of its listed roots, blocks and windows (a list column each of kind, quick, a, b)."""
    owner = np.repeat(np.arange(len(p.words.doc_at) - 1), np.diff(listed[0].offsets.to_numpy()))
    kind, quick, a, b = (x.flatten().to_numpy() for x in listed)
    known = {(t, k, x, y) for t, k, x, y in zip(owner.tolist(), kind.tolist(), a.tolist(), b.tolist(), strict=True)}
    step = np.zeros(len(p.words.hash) + 1, np.int64)

    def take(text, kind, first, last):
        name = p.names(first, last).tolist()
        here = [(t, kind, x, y) in known for t, (x, y) in zip(text.tolist(), name, strict=True)]
        np.add.at(step, first[here], 1)
        np.add.at(step, last[here], -1)

    some, _ = p.roots()
    take(some, ROOT, p.words.doc_at[some], p.words.doc_at[some + 1])
    take(np.searchsorted(p.words.doc_at, p.first, "right") - 1, BLOCK, p.first, p.last)
    windows = kind == WINDOW
    near = _among(p.quick() >> U(32), p.text, quick[windows].view(np.uint32).astype(U), owner[windows])
    take(p.text[near], WINDOW, p.at[near], p.at[near] + p.window)
    mask = np.cumsum(step)[:-1] > 0
    for i, j in zip(p.words.doc_at[:-1].tolist(), p.words.doc_at[1:].tolist(), strict=True):
        yield mask[i:j]


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, row, i, array_to_string(w[i : i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
first AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT row, p FROM (SELECT row, unnest(range(i, i + 13)) AS p FROM windows JOIN first USING (g) WHERE doc_id > least)),
words AS (SELECT row, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (row, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)
"""

"""Near-duplicates by ProbMinHash.

A document is a weighted set: its shingles of five words, each with its count.  Every shingle is a
Poisson process of arrivals at a rate of its weight; an arrival falls into a random one of M
registers, and a register keeps the shingle that came first.  A shingle stops when its next arrival
is later than every register's first.  Two documents agree in a register with the probability of
their probability Jaccard similarity J_P.

BANDS bands of ROWS registers give candidate buckets: at J_P = 0.8 a pair shares no bucket with
probability (1 - 0.8**6)**32 < 1e-4.  A bucket isn't expanded into pairs.  Its leader is the member
that shares most with others over CENTRAL bands (an original among its copies); each member is verified
against the leader by the exact J_P of the whole texts, their words compared as such.  Links of at
least ``threshold`` make classes.

In buckets that then still hold members of different classes every pair of different classes is a
candidate, whether its members are like their leaders or not.  All members are dealt to tiles of
TILE, those of the smaller classes to tiles too, and each pair of such tiles meets in one task, so that
members of the largest class never meet for their own sake and no task holds a large bucket.  In a
task a pair whose registers agree less often than a pair of ``threshold`` does but once in a million
(1 / RARE, beside the bands' 1e-4) is passed over, as is one that shares an earlier bucket.
Only members that then still have a candidate come again, with their texts, and their exact J_P
decides.  A task gives links that join its classes: at most one a member, never its pairs.

Texts are known by a digest and numbered; doc_id only says which of them is least.

Defined cases: equal texts are one text (their least doc_id stands for them); a text of one to four
words is one shingle; a text without words, and a null text, links to equal texts only, null to
none; rows with equal doc_id and text are one document, and rows with equal doc_id but other texts
one each; an empty table gives no rows; other columns are ignored, or kept by ``keep_first``.
"""

from __future__ import annotations

from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 6
M = BANDS * ROWS
#: Bands that tell how central a document is.
CENTRAL = 10
#: Members of a bucket that meet in one task are two tiles of about so many at most.
TILE = 512
#: One in so many pairs of the threshold agrees in fewer registers than ``least_agreement``.
RARE = 1_000_000
U = np.uint64
#: A list of texts up to this long is broadcast (32 bytes a text) to fetch them; a longer one is shuffled with the texts.
SMALL = 100_000


def shingles(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), in order, of a group of texts."""
    n = w.counts()
    k = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), k)
    first = np.repeat(w.doc_at[:-1] - (np.cumsum(k) - k), k) + np.arange(len(text))
    last = np.minimum(first + SHINGLE, w.doc_at[1:][text])
    h = words.range_hashes(words.prefix_sums(w.hash), first, last)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """texts x m winners.  All shingles of all texts draw their next arrival together, until each is late."""
    first, winner = np.full(texts * m, np.inf), np.zeros(texts * m, U)
    t, k, live = np.zeros(len(shingle)), 0, np.arange(len(shingle))
    while len(live):
        h = words.mix(shingle[live] + U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        register = ((h & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
        uniform = ((words.mix(h) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = t[live] - np.log(uniform) / weight[live]
        t[live] = x
        place = text[live] * m + register
        np.minimum.at(first, place, x)
        won = first[place] == x
        winner[place[won]] = shingle[live[won]]
        late = first.reshape(texts, m).max(1)
        live, k = live[x < late[text[live]]], k + 1
    return winner.reshape(texts, m)


def bands(winner: np.ndarray) -> np.ndarray:
    """texts x BANDS keys as signed longs; the band is part of its key."""
    part = winner.reshape(len(winner), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1).astype(U), part.shape[:2]).copy()
    for r in range(ROWS):
        h = words.mix(h * U(0x9FB21C651E98DF25) + part[:, :, r])
    return h.view(np.int64)


def shingle_counts(text: bytes) -> Counter:
    """The shingles of a text as tuples of its words, each with its count."""
    found = text.split()
    if len(found) < SHINGLE:
        return Counter([tuple(found)] if found else [])
    return Counter(zip(*(found[k:] for k in range(SHINGLE)), strict=False))


def probability_jaccard(a: Counter, b: Counter) -> float:
    """Exact J_P of two weighted sets."""
    # elements by their two weights: there are few different ones
    kinds = Counter(zip(map(a.__getitem__, a), map(b.__getitem__, a), strict=True))
    kinds.update((0, y) for e, y in b.items() if e not in a)
    x, y, n = (np.array(c, float) for c in zip(*((x, y, n) for (x, y), n in kinds.items()), strict=True)) if kinds else (np.zeros(0),) * 3
    return sum(float(c / (n * np.maximum(x / s, y / t)).sum()) for s, t, c in zip(x, y, n, strict=True) if s > 0 and t > 0)


def least_agreement(threshold: float, m: int = M) -> int:
    """The registers that a pair of J_P = threshold agrees in, but for one pair in RARE (registers are independent)."""
    below = 0.0
    for c in range(m + 1):
        below += comb(m, c) * threshold**c * (1 - threshold) ** (m - c)
        if below > 1 / RARE:
            return c
    return m


def _text_bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sign(batches):
    common.held("near_duplicates")
    for b in common.slices(batches, 512):
        texts = _text_bytes(b.column(2))
        for i, j in words.groups(texts):
            w = words.Words(texts[i:j])
            text, shingle, weight = shingles(w)
            winner = signatures(text, shingle, weight, j - i)
            keys, sketch = bands(winner), (winner & U(255)).astype(np.uint8)
            some = np.zeros(j - i, bool)
            some[text] = True
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[some].ravel())), pa.array([x.tobytes() for x in sketch])],
                ["doc_id", "digest", "bands", "sketch"],
            )


def _buckets(reps: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(doc, key, band, size) of the buckets with two members or more; all that follows works on these."""
    rows = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    sizes = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    return scratch.keep(rows.join(sizes, "key").select("doc", "key", F.col("band").cast("byte").alias("band"), "size"), "buckets")


def _led(rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(doc, leader) in every bucket, of its members and the most central one: that with the most company in the first CENTRAL bands.

    The leaders are written before they are joined: both sides are then plain shuffles, whose large partitions Spark may split.
    """
    score = scratch.keep(rows.groupBy("doc").agg(F.sum(F.when(F.col("band") < CENTRAL, F.col("size")).otherwise(0)).alias("score")), "scores")
    best = rows.select("doc", "key").join(score, "doc").groupBy("key").agg(F.max(F.struct("score", (-F.col("doc")).alias("minus"))).alias("best"))
    leader = scratch.keep(best.select("key", (-F.col("best.minus")).alias("leader")), "leaders")
    return rows.select("doc", "key").join(leader, "key").where("doc <> leader").select("doc", "leader")


def _texts_of(asked: DataFrame, texts: DataFrame, first: DataFrame) -> DataFrame:
    """(doc, text) of the documents (doc) asked for.

    ``texts``: (doc_id, digest, text) of all rows; ``first`` names the row that stands for each text.
    """
    rows = asked.join(first.select("doc", F.col("rep").alias("doc_id"), "digest"), "doc")
    if asked.count() <= SMALL:
        rows = F.broadcast(rows)
    # a row may stand more than once in the input
    return texts.join(rows, ["doc_id", "digest"]).groupBy("doc").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, first: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(doc, leader, similarity) of distinct pairs, by the exact J_P of the whole texts."""
    pairs = scratch.keep(pairs.distinct(), "pairs")

    def run(batches):
        common.held("near_duplicates")
        kept, shown = -1, None
        for b in common.slices(batches, 64):
            raw = [_text_bytes(b.column(2)), _text_bytes(b.column(3))]
            leaders, found = b.column(1).to_pylist(), []
            for k, (one, two) in enumerate(zip(*raw, strict=True)):
                if leaders[k] != kept:
                    kept, shown = leaders[k], shingle_counts(two)
                found.append(probability_jaccard(shingle_counts(one), shown))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], ["doc", "leader", "similarity"])

    # a document has BANDS leaders at most, a leader any number of documents: its text is written before the join, which may then be split
    leaders = scratch.keep(_texts_of(pairs.select(F.col("leader").alias("doc")).distinct(), texts, first), "leader-texts")
    own = pairs.join(_texts_of(pairs.select("doc").distinct(), texts, first), "doc")
    joined = own.join(leaders.select(F.col("doc").alias("leader"), F.col("text").alias("other")), "leader")
    out = joined.select("doc", "leader", "text", "other").sortWithinPartitions("leader").transform(common.arrow, run, "doc long, leader long, similarity double")
    out = scratch.keep(out, "verified")
    scratch.drop("leader-texts", "pairs")
    return out


class Tile:
    """Members that meet in one task: rows 0, 1, ... with a class (root), a role (1: of a smaller class, looks for partners among those of role 0), registers and bands."""

    def __init__(self, key: int, doc: np.ndarray, root: np.ndarray, role: np.ndarray, sketch: np.ndarray, bands: np.ndarray, minor: np.ndarray):
        self.doc, self.root, self.sketch, self.bands, self.minor = doc, root.copy(), sketch, bands, minor
        self.here, self.asking = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        self.band = int(np.flatnonzero(bands[0] == key)[0])

    def partners(self, i: int, least: int) -> np.ndarray:
        """Rows of another class that agree with row i in ``least`` registers and meet it here first."""
        other = self.here[self.root[self.here] != self.root[i]]
        # two members of smaller classes ask each other: once is enough
        other = other[~self.minor[other] | (self.doc[other] < self.doc[i])]
        other = other[(self.sketch[other] == self.sketch[i]).sum(1) >= least]
        return other[(self.bands[other] == self.bands[i]).argmax(1) == self.band]


def _tiles(batches, texts: bool):
    """(key and tile numbers, Tile, texts) of rows that come sorted by key and tile."""
    held: list[pa.RecordBatch] = []
    last = None

    def made():
        t = pa.Table.from_batches(held)
        number = [t.column(c).to_numpy() for c in range(7)]
        sketch = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, M)
        bands = np.concatenate([x.flatten().to_numpy() for x in t.column(8).chunks]).reshape(-1, BANDS)
        raw = [x.encode() for x in t.column(9).to_pylist()] if texts else None
        return last, Tile(last[0], number[3], number[4], number[5], sketch, bands, number[6] != 0), raw

    for b in batches:
        if not b.num_rows:
            continue
        where = np.column_stack([b.column(c).to_numpy() for c in range(3)])
        starts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1, [b.num_rows]])
        for first, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            this = tuple(where[first].tolist())
            if held and this != last:
                yield made()
                held.clear()
            last = this
            held.append(b.slice(first, end - first))
    if held:
        yield made()


def _asked(least: int):
    """Of each tile, the members that have a partner to be verified with."""

    def run(batches):
        common.held("near_duplicates")
        out: list[tuple] = []
        for (key, i, j), tile, _ in _tiles(batches, False):
            some = np.zeros(len(tile.doc), bool)
            for k in tile.asking:
                other = tile.partners(k, least)
                some[other] = True
                some[k] |= len(other) > 0
            at = np.flatnonzero(some)
            if len(at):
                out.append((np.full(len(at), key), np.full(len(at), i, np.int32), np.full(len(at), j, np.int32), tile.doc[at], np.isin(at, tile.asking).astype(np.int32)))
            if sum(len(x[0]) for x in out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "i", "j", "doc", "role"])
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "i", "j", "doc", "role"])

    return run


def _tile_links(tile: Tile, texts: list[bytes], least: int, threshold: float) -> tuple[list[int], list[int]]:
    """Pairs of rows whose exact J_P is ``threshold`` at least, as many as join what can be joined."""
    counts = [shingle_counts(t) for t in texts]
    known: dict[tuple, int] = {}
    ids = [np.array([known.setdefault(e, len(known)) for e in c], np.int64) for c in counts]
    weight = [np.fromiter(c.values(), np.int64, len(c)) for c in counts]
    n = np.array([len(x) for x in ids])
    at, flat, heavy = np.cumsum(n) - n, np.concatenate(ids), np.concatenate(weight)
    total = np.array([x.sum() for x in weight])
    own, a, b = np.zeros(len(known), np.int64), [], []
    for i in tile.asking:
        other = tile.partners(i, least)
        if not len(other):
            continue
        # J_P is at most the sum of the greater weights of common shingles over that of all
        own[ids[i]] = weight[i]
        x, y = words.gather(heavy, at[other], n[other]), own[words.gather(flat, at[other], n[other])]
        own[ids[i]] = 0
        cut = np.cumsum(n[other]) - n[other]
        common_max, common_min = np.add.reduceat(np.where(y > 0, np.maximum(x, y), 0), cut), np.add.reduceat(np.minimum(x, y), cut)
        for j in other[common_max >= (threshold - 1e-9) * (total[other] + total[i] - common_min)].tolist():
            if tile.root[j] != tile.root[i] and probability_jaccard(counts[i], counts[j]) >= threshold:
                tile.root[tile.root == tile.root[j]] = tile.root[i]
                a.append(i)
                b.append(j)
    return a, b


def _verifying(least: int, threshold: float):
    def run(batches):
        common.held("near_duplicates")
        for _, tile, texts in _tiles(batches, True):
            a, b = _tile_links(tile, texts, least, threshold)
            if a:
                x, y = tile.doc[a], tile.doc[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _rest(reps: DataFrame, buckets: DataFrame, roots: DataFrame, texts: DataFrame, first: DataFrame, threshold: float, scratch: common.Scratch) -> DataFrame:
    """(a, b): verified links between members of buckets that aren't of one class by ``roots``; they join all classes that any pair joins."""
    rows = buckets.select("doc", "key").join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select("doc", "key", F.coalesce("root", "doc").alias("root"))
    rows = scratch.keep(rows, "rows")
    of_class = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = of_class.groupBy("key").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("size"), F.count("*").alias("classes")).where("classes > 1")
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    mixed = scratch.keep(mixed.select("key", F.col("major.root").alias("major"), tiles(F.col("size")).alias("here"), tiles(F.col("size") - F.col("major.n")).alias("asking")), "mixed")
    met = rows.join(mixed, "key").select("doc", "root", "key", "here", "asking", (F.col("root") != F.col("major")).alias("minor"))
    every, place = lambda n: F.sequence(F.lit(0), n - 1), lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    stay = met.select("doc", "root", "key", place(F.col("here")).alias("i"), F.explode(every(F.col("asking"))).alias("j"), F.lit(0).alias("role"), F.col("minor").cast("int").alias("minor"))
    ask = met.where("minor").select("doc", "root", "key", F.explode(every(F.col("here"))).alias("i"), place(F.col("asking")).alias("j"), F.lit(1).alias("role"), F.lit(1).alias("minor"))
    order, least = ["key", "i", "j", "doc", "root", "role", "minor", "sketch", "bands"], least_agreement(threshold)
    met = scratch.keep(stay.unionByName(ask), "met")
    own = reps.select("doc", "sketch", "bands")

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*order, *more).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc")

    asked = dealt(met.join(own, "doc")).transform(common.arrow, _asked(least), "key long, i int, j int, doc long, role int")
    asked = scratch.keep(asked, "asked")
    named = _texts_of(asked.select("doc").distinct(), texts, first)
    told = scratch.keep(named, "told")
    again = asked.join(met, ["key", "i", "j", "doc", "role"]).join(own, "doc").join(told, "doc")
    return dealt(again, "text").transform(common.arrow, _verifying(least, threshold), "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_copies (rows with an equal text), n_links (links of its text that were verified and join its class)."""
    # rows of one id and text are one; by a tag, as the join by digest has to be free to split a text that stands very often
    known = _classes(docs, threshold).select("doc_id", "class_id", "n_copies", "n_links", F.xxhash64("digest").alias("tag")).distinct().drop("tag")
    rest = docs.where("text IS NULL OR doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    return known.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """What ``classes`` gives for every row with an id and a text, and the text's digest."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "near", alike=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.col("text").alias("text"))
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    signed = scratch.keep(texts.transform(common.arrow, _sign, "doc_id long, digest binary, bands array<long>, sketch binary"), "signed")
    # each distinct text has a number, ``doc``; written, so that it stays the same
    first = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    first = scratch.keep(first.withColumn("doc", F.monotonically_increasing_id()), "first")
    reps = first.where(F.size("bands") > 0).select("doc", "bands", "sketch")
    buckets = _buckets(reps, scratch)

    like = F.col("similarity") >= threshold
    tested = _verified(_led(buckets, scratch), texts, first, scratch)
    scratch.drop("sizes", "scores", "leaders")
    close = scratch.keep(tested.where(like).select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct(), "close")
    rest = _rest(reps, buckets, components(close, common.Scratch(spark, "near", alike=True)), texts, first, threshold, scratch)
    kept = scratch.keep(close.unionByName(rest).distinct(), "links")
    scratch.drop("buckets", "rows", "mixed", "met", "asked", "told", "close")
    roots = components(kept, scratch)
    degree = kept.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    named = first.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").join(degree, "doc", "left")
    named = scratch.keep(named.select("digest", "rep", F.coalesce("root", "doc").alias("root"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    # the least doc_id of each class of two texts or more
    least = scratch.keep(named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    named = scratch.keep(named.join(least, "root", "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"), "n_copies", "n_links"), "classes")
    return signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "digest", "class_id", "n_copies", "n_links")


def _digest(text):
    """128 bits of SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents without those whose class has one with a smaller doc_id, with all their columns.

    Rows are judged by doc_id and text: of rows with equal doc_id only those whose text's class has a smaller one go.
    """
    scratch = common.Scratch(docs.sparkSession, "near", alike=True)
    drop = scratch.keep(_classes(docs, threshold).where("class_id < doc_id").select(F.col("doc_id").alias("id"), F.col("digest").alias("of")), "drop")
    gone = (F.col("of") == _digest(docs["text"])) & (F.col("id") == docs["doc_id"])
    return docs.join(drop, gone, "left_anti").select(docs.columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))

"""Prefix trie of conversations by chained digests.

A turn's name is the SHA-256 of its role and text (the role with its length before it).  The digest of
a prefix is the SHA-256 of the digest one turn shorter followed by the turn's name, from the empty
root on: equal sequences of turns, and only these, have equal digests.  So a node is a group of
(depth, digest), and no text moves between tasks.

*Rebuilding.*  Conversation c begins with the first h turns of conversation c - c % 20, h = crc32 of c
in decimals modulo 4, and goes on with its own turns after its first h.

*Long conversations.*  Turns are numbered in ranges of (conversation, turn); digests are chained in
blocks of ``BLOCK`` turns, and only the last digest of each block of a conversation of several goes from block to
block, in a pass over sorted rows.  Sums along a path are taken in blocks, too.

*Subtree sums.*  A node's least member c holds the node and all its ancestors on its own path.  What c's nodes
have to give is first summed along the path of c, then each prefix of c (each ancestor) gets one row, and
rows are added up by (depth, digest): linear in the prefixes, where one row a pair of node and ancestor
is quadratic in the depth.

*Members that end at a node* are written out in pieces of ``BLOCK`` neighbouring ids, hashed one after the other
in a pass over sorted rows: a node in which very many conversations end is never held in one place.

Defined cases: a null role or text is empty; turns of equal number are in the order of their names;
repeated turns are turns; turns without a conv_id belong to no conversation and are left out; an
empty table has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, sharding

#: Turns of a block, and conversation ids of a piece.
BLOCK = 256
#: Conversations that share an opening, and the number of lengths it may have.
FAMILY, OPENINGS = 20, 4


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def numbered(turns: DataFrame, scratch: common.Scratch) -> DataFrame:
    """conv, i, name, n_words of every turn; i from 0 without gaps."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("name"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
    )
    # the last key keeps rows that are equal in all others from falling into one range
    ranges = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv", F.asc_nulls_first("turn"), "name", "tie")
    ranges = scratch.keep(ranges.drop("tie").withColumn("range", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("conv", "range").count().select("conv", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), "name"))
    placed = ranges.withColumn("at", place - 1)
    return placed.join(starts, ["conv", "range"]).select("conv", (F.col("start") + F.col("at")).alias("i"), "name", "n_words")


def opening(conv: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % OPENINGS


def rebuilt(turns: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, name, n_words, ends) of every rebuilt turn, depth from 1; (conv, ends) of every root, ``ends`` where there is no turn."""
    # each conversation's blocks, one row each, meet its family's first; its turns meet their block
    blocks = turns.where(F.col("i") % block == 0).select("conv", F.floor(F.col("i") / block).alias("block"))
    own = turns.groupBy("conv").agg((F.max("i") + 1).alias("n_own"))
    convs = own.select("conv", "n_own", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), opening(F.col("conv")).alias("h"))
    heads = turns.where(F.col("i") < OPENINGS - 1).select(F.col("conv").alias("base"), "i", "name", "n_words")
    sizes = heads.groupBy("base").agg(F.count("*").alias("n"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))

    def placed(rows: DataFrame, depth: Column) -> DataFrame:
        return rows.withColumn("depth", depth).select("conv", "depth", "name", "n_words", (F.col("depth") == F.col("length")).alias("ends"))

    # at most FAMILY conversations meet the few turns of a head
    taken = placed(convs.join(heads, "base").where(F.col("i") < F.col("taken")), F.col("i") + 1)
    moved = blocks.join(convs, "conv").select("conv", "block", "h", "taken", "length")
    rest = turns.withColumn("block", F.floor(F.col("i") / block)).join(moved, ["conv", "block"]).where(F.col("i") >= F.col("h"))
    return taken.unionByName(placed(rest, F.col("i") - F.col("h") + F.col("taken") + 1)), convs.select("conv", (F.col("length") == 0).alias("ends"))


def _chain(last: Column, turns: Column) -> Column:
    """The digests of ``turns`` (structs in order with ``name``), from ``last`` on."""
    start = F.struct(last.alias("last"), F.array().cast("array<binary>").alias("every"))

    def step(s: Column, t: Column) -> Column:
        digest = _sha(F.concat(s["last"], t["name"]))
        return F.struct(digest.alias("last"), F.concat(s["every"], F.array(digest)).alias("every"))

    return F.aggregate(turns, start, step, lambda s: s["every"])


def _carried(blocks: DataFrame) -> DataFrame:
    """conv, block, carry for the blocks after the first: rows (conv, block, names) sorted by conversation, one block of names held at a time."""

    def run(batches):
        conv, last = None, b""
        for b in common.slices(batches):
            out = []
            for c, names in zip(b.column("conv").to_pylist(), b.column("names").to_pylist(), strict=True):
                if c != conv:
                    conv, last = c, b""
                out.append(last)
                for name in names:
                    last = sha256(last + name).digest()
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(out, pa.binary())], ["conv", "block", "carry"])

    return blocks.repartition("conv").sortWithinPartitions("conv", "block").transform(common.arrow, run, "conv long, block long, carry binary")


def prefixes(turns: DataFrame, roots: DataFrame, scratch: common.Scratch, block: int) -> DataFrame:
    """conv, depth, digest, n_words, ends of every prefix of every conversation, the root's too."""
    cut = turns.withColumn("block", F.floor((F.col("depth") - 1) / block)).groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("depth", "name", "n_words", "ends"))).alias("turns"))
    cut = scratch.keep(cut, "blocks")
    long = cut.join(cut.where("block = 1").select("conv"), "conv", "left_semi")
    carry = _carried(long.select("conv", "block", F.transform("turns", lambda t: t["name"]).alias("names")))
    cut = cut.join(carry, ["conv", "block"], "left").withColumn("digests", _chain(F.coalesce("carry", F.lit(b"")), F.col("turns")))
    rows = cut.select("conv", F.explode(F.arrays_zip("turns", "digests")).alias("t")).select("conv", "t.turns.depth", F.col("t.digests").alias("digest"), "t.turns.n_words", "t.turns.ends")
    zero = F.lit(0).cast("long")
    return scratch.keep(rows.unionByName(roots.select("conv", zero.alias("depth"), F.lit(b"").alias("digest"), zero.alias("n_words"), "ends")), "prefixes")


def _summed_from_below(rows: DataFrame, block: int, *values: str) -> DataFrame:
    """``values`` of rows (conv, depth, ..) summed over this and all greater depths of the conversation."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / block))
    after = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(*[F.sum(v).alias(v) for v in values])
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(v).over(after), F.lit(0)).alias(f"{v}_after") for v in values])
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        rows = rows.withColumn(f"{v}_inside", F.sum(v).over(inside))
    return rows.join(blocks, ["conv", "block"]).select("conv", "depth", "digest", "child", *[(F.col(f"{v}_inside") + F.col(f"{v}_after")).alias(v) for v in values])


def _hashed_ends(prefixes: DataFrame, block: int) -> DataFrame:
    """depth, digest, ends_sha256 of the nodes in which a conversation ends."""
    pieces = prefixes.where("ends").withColumn("piece", F.floor(F.col("conv") / block)).groupBy("depth", "digest", "piece")
    pieces = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        node, h = None, None
        for b in common.slices(batches):
            done = []
            for depth, digest, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
                if (depth, digest) != node:
                    if h is not None:
                        done.append((*node, h.hexdigest()))
                    node, h = (depth, digest), sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _rows(done)
        if h is not None:
            yield _rows([(*node, h.hexdigest())])

    def _rows(done):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "digest", "ends_sha256"])

    return pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "piece").transform(common.arrow, run, "depth long, digest binary, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest of every node."""
    scratch = common.Scratch(conversations.sparkSession, "trie")
    turns, roots = rebuilt(scratch.keep(numbered(conversations, scratch), "numbered"), block)
    every = prefixes(turns, roots, scratch, block)
    scratch.drop("turns", "numbered", "blocks")

    nodes = every.groupBy("depth", "digest").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("n_words").alias("n_words"), F.min("ends").alias("leaf"))
    nodes = scratch.keep(nodes, "nodes")
    # what a node gives stands at its least member; a node is a child of the prefix one shorter
    zero = F.lit(0).cast("long")
    gives = [
        every.select("conv", "depth", "digest", zero.alias("saved"), zero.alias("leaves"), zero.alias("child")),
        nodes.select("conv", "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), F.col("leaf").cast("long").alias("leaves"), zero.alias("child")),
        nodes.where("depth > 0").select("conv", (F.col("depth") - 1).alias("depth"), F.lit(None).cast("binary").alias("digest"), zero.alias("saved"), zero.alias("leaves"), F.lit(1).cast("long").alias("child")),
    ]
    path = gives[0].unionByName(gives[1]).unionByName(gives[2]).groupBy("conv", "depth")
    path = path.agg(F.max("digest").alias("digest"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.sum("child").alias("child"))
    path = _summed_from_below(path, block, "saved", "leaves").where("saved > 0 or leaves > 0 or child > 0")
    sums = path.groupBy("depth", "digest").agg(F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    # a node's parent has the same least member, but for the topmost node of that member; those below the root have the root's
    mine = nodes.select("conv", "depth")
    tops = mine.join(mine.select("conv", (F.col("depth") + 1).alias("depth")), ["conv", "depth"], "left_anti").where("depth > 1")
    above = tops.select("conv", (F.col("depth") - 1).alias("depth")).join(every.select("conv", "depth", "digest"), ["conv", "depth"])
    least = nodes.select("depth", "digest", F.col("conv").alias("parent"))
    tops = above.join(least, ["depth", "digest"]).select("conv", (F.col("depth") + 1).alias("depth"), "parent")
    root = nodes.where("depth = 0").select("conv").first()
    parent = F.when(F.col("depth") > 1, F.coalesce("parent", "conv")).when(F.col("depth") == 1, F.lit(root and root["conv"]).cast("long"))
    nodes = nodes.join(tops, ["conv", "depth"], "left").withColumn("parent", parent)

    nodes = nodes.join(sums, ["depth", "digest"]).join(_hashed_ends(every, block), ["depth", "digest"], "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"), "digest",
    )  # fmt: skip


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations")).drop("digest")


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id AS conv, sha256(strlen(r) || ':' || r || x) AS name, len(regexp_extract_all(x, '[^ 	-]+')) AS words, turn
  FROM (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv, list(name ORDER BY turn NULLS FIRST, name) AS names, list(words ORDER BY turn NULLS FIRST, name) AS words FROM t GROUP BY 1),
crc AS (SELECT [CRC_TABLE]::BIGINT[] AS t),
h AS (SELECT conv, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(conv AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h FROM o CROSS JOIN crc),
c AS (SELECT o.conv, coalesce(b.names[1 : h], []) || o.names[h + 1 :] AS names, coalesce(b.words[1 : h], []) || o.words[h + 1 :] AS words
  FROM o JOIN h USING (conv) LEFT JOIN o AS b ON b.conv = o.conv - o.conv % 20),
p AS (SELECT conv, d AS depth, array_to_string(names[1 : d], ' ') AS path, array_to_string(names[1 : d - 1], ' ') AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(names) AS ends
  FROM c, unnest(range(0, len(names) + 1)) AS u(d)),
n AS (SELECT depth, path, any_value(up) AS up, min(conv) AS conv, count(*) AS n, any_value(words) AS words, bool_and(ends) AS leaf,
  sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (ends), '')) AS ends FROM p GROUP BY 1, 2),
k AS (SELECT depth, up, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2),
s AS (SELECT p.depth, p.path, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (n.leaf) AS leaves FROM n JOIN p ON p.conv = n.conv AND p.depth <= n.depth GROUP BY 1, 2)
SELECT n.conv AS conv_id, n.depth, parent.conv AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.path = n.path LEFT JOIN k ON k.depth = n.depth + 1 AND k.up = n.path
LEFT JOIN n AS parent ON n.depth > 0 AND parent.depth = n.depth - 1 AND parent.path = n.up
""".replace("CRC_TABLE", ", ".join(map(str, sharding._crc_table())))

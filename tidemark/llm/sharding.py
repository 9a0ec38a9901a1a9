"""Shards by jump consistent hashing, in SQL functions only.

The published algorithm draws, from a 64-bit linear congruential generator seeded with the key, the
next number of shards at which the key would move; the last move below the number of shards is its
shard.  No table of the ring is kept, and with one more shard a key either stays or moves into it.

Spark's ANSI mode refuses products over 63 bits, so the generator runs on 16-bit limbs; the jump
itself is the algorithm's own double-precision quotient.

``slot`` numbers a shard's rows from 0 without gaps, by id: rows are cut into ranges of the id, a
shard's slots in a range begin after those of the ranges before it, and only (range, shard) groups
are ordered.  No task holds a whole shard.

Defined cases: a null text has size 1 and crc 0; a null id is hashed as 0 and comes first in its
shard; rows with equal ids share a shard and are ordered by crc and size; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The generator's published multiplier.
MULTIPLIER = 2862933555777941757
RANGES = 256


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in range(4)]


def next_state(x: Column) -> Column:
    """x * MULTIPLIER + 1 modulo 2**64, as a signed long."""
    a, b = _limbs(x), [MULTIPLIER >> 16 * k & 0xFFFF for k in range(4)]
    out, carry = F.lit(0).cast("long"), F.lit(1).cast("long")
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + a[i] * F.lit(b[k - i]).cast("long")
        out = out.bitwiseOR(F.shiftleft(total.bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * k))
        carry = F.shiftrightunsigned(total, 16)
    return out


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key.  A key moves at most ``shards`` times, so that many steps settle it."""
    start = F.struct(F.coalesce(key, F.lit(0)).cast("long").alias("x"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        x = next_state(s["x"])
        quotient = F.lit(float(1 << 31)) / (F.shiftrightunsigned(x, 33) + 1).cast("double")
        moved = F.struct(x.alias("x"), s["j"].alias("b"), F.floor((s["j"] + 1).cast("double") * quotient).cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).select("*", jump_shard(F.col("doc_id"), shards).alias("shard"), jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))

    # ranges of the id by approximate quantiles: their number is a parameter, so they fit in the plan
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / ranges for k in range(1, ranges)], 10 * ranges).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    where = F.lit(0)
    if cuts:
        where = F.coalesce(F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("range", where)
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "range").count().select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    # shards * ranges rows at most
    rows = rows.join(F.broadcast(starts), ["shard", "range"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.row_number().over(order) - 1 + F.col("start")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """All columns of the documents, in one folder a shard."""
    docs.withColumn("shard", jump_shard(F.col("doc_id").cast("long"), shards)).write.partitionBy("shard").mode("overwrite").parquet(path)


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(common.table(spark, sf_dir, "documents"), 8)


def _crc_table() -> list[int]:
    """The table of the CRC-32 that zlib computes, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


ORACLE_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS k FROM documents),
walk(k, x, b, j) AS (
  SELECT k, (CAST(k AS HUGEINT) + 18446744073709551616) % 18446744073709551616, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM ids
  UNION ALL
  SELECT k, y, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(y // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT k, b, j, (x * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616 AS y FROM walk WHERE j < 9)
),
homes AS (SELECT k, CAST(max(b) FILTER (b < 8) AS INTEGER) AS shard, CAST(max(b) FILTER (b < 9) AS INTEGER) AS grown_shard FROM walk GROUP BY 1),
crc AS (SELECT [{", ".join(map(str, _crc_table()))}]::BIGINT[] AS t),
d AS (SELECT doc_id, coalesce(doc_id, 0) AS k, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, k, size, xor(list_reduce(bytes, lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d CROSS JOIN crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM c JOIN homes USING (k)
"""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from tidemark.llm import sharding


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_hash_agrees_with_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(7, 4000, 37)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 60):
        assert [r[0] for r in df.select(sharding.jump_shard(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(5000).select(sharding.jump_shard(F.col("id"), 8).alias("a"), sharding.jump_shard(F.col("id"), 9).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert all(r.b == 8 for r in moved) and 400 < len(moved) < 700


def test_slots_have_no_gaps(odd, empty):
    rows = sharding.assign_shards(odd, 8, ranges=4).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append((r.slot, r.doc_id))
        assert r.shard == jump(r.doc_id or 0, 8) and r.law == "key"
    for s in slots.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s)))
        ids = [x[1] for x in s if x[1] is not None]
        assert ids == sorted(ids)
    sizes = {(r.doc_id, r["size"], r.text_crc32) for r in rows}
    assert sizes == {(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    assert sharding.assign_shards(empty, 8).count() == 0

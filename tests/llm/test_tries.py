import math
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F
from tidemark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string"


def name(role, text):
    return sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, name(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, leaf_of, words = defaultdict(list), {}, {}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members) for m in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = tries.trie(df, **more)
    return sorted((tuple(r) for r in got.drop("digest").collect()), key=str)


def talk(c, turns, start=0):
    return [(c, start + i, r, t, 1, "clash") for i, (r, t) in enumerate(turns)]


def test_against_brute_force(spark):
    draw = random.Random(4)
    say = lambda: (draw.choice(["user", "assistant", None, ""]), draw.choice([None, "", "a", "a b", "a  b c", " ", "é\tx\x0by", "a b"]))
    rows = []
    for c in [*range(0, 90), -1, -7, -20, -40, 10**12, 2**62]:
        if c in (20, 47):  # a family without its first, and one that is absent
            continue
        rows += talk(c, [say() for _ in range(draw.choice([1, 1, 2, 3, 5, 9]))], draw.choice([0, 5]))
    rows += [(3, None, "user", "first", 1, ""), (3, None, "user", "first", 1, ""), (4, 1, "user", "tie", 1, ""), (4, 1, "user", "tie b", 1, ""), (None, 0, "user", "nobody", 1, "")]
    expected = brute(rows)
    assert found(spark, rows) == expected
    assert found(spark, rows, block=2) == expected


def test_long_conversations_and_copies(spark):
    """A chain over several blocks, conversations that leave it at different places, and many that end in one node."""
    long = [("user", f"turn {i % 7}") for i in range(41)]
    rows = []
    for c in (100, 101, 105, 160, 161):
        rows += talk(c, long)
    for k in range(6):
        rows += talk(200 + k, long[: 7 * k + 3] + [("user", f"own {k}")])
    for c in range(300, 380):
        rows += talk(c, [("user", "hello"), ("assistant", "hello to you")])
    for c in range(400, 420):
        rows += talk(c, [("user", "hello"), ("assistant", f"number {c}"), ("user", "end")])
    expected = brute(rows)
    assert found(spark, rows, block=4) == expected
    assert found(spark, rows) == expected


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.trie(empty).count() == 0 and tries.trie(empty.withColumn("conv_id", F.lit(None).cast("long"))).count() == 0
    # one turn that its family's first, which is absent, would have given: a turnless conversation
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert found(spark, talk(c, [("user", "one")])) == [(c, 0, None, 1, 0, 1, 0, sha256(str(c).encode()).hexdigest())]
    rows = talk(0, [("user", "x" * 200_000), (None, None)])
    assert found(spark, rows) == brute(rows)


def test_digests_tell_role_from_text(spark):
    rows = talk(0, [("user", "1")]) + talk(20, [("use", "r1")]) + talk(40, [("", "user1")]) + talk(60, [("user", "1")])
    assert found(spark, rows) == brute(rows)

import math
import random
import re
from collections import Counter

from tidemark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    live = [(i, c) for i, c in docs if c]
    n_docs, length = len(live), sum(sum(c.values()) for _, c in live)
    df = Counter(t for _, c in live for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scores = []
        for i, c in live:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(a, b, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_against_brute_force(spark):
    draw = random.Random(2)
    common = [f"c{i}" for i in range(8)]
    text = lambda n, rare: " ".join(draw.choice(common) if draw.random() < 0.7 else f"R{draw.randrange(rare)}é" for _ in range(n))
    docs = [(i, text(draw.randrange(0, 120), 60)) for i in range(300)]
    docs += [(1000 - i, "c1 r1é same copy") for i in range(40)] + [(None, "c1 r1é same copy"), (7, "c1 r1é same copy"), (7, "c1"), (400, None), (401, ""), (402, "C1-c1_c1 R1É")]
    items = [(i, text(draw.randrange(1, 40), 60)) for i in range(12)] + [(20, "r1é SAME copy copy"), (21, None), (22, "!"), (23, "unheard"), (24, "c1"), (24, "c1"), (24, "c2 c3"), (None, "r5é")]
    expected = brute(docs, items)
    assert found(spark, docs, items) == expected
    assert found(spark, docs, items, segment=200) == expected
    assert found(spark, docs, items, block_terms=15) == expected
    assert found(spark, docs, items, k=1) == brute(docs, items, 1)


def test_reading_stops_before_the_end_of_the_lists(spark):
    import numpy as np

    n, draw = 5000, np.random.default_rng(0)
    tf = np.sort(draw.integers(1, 50, 2 * n))[::-1].reshape(n, 2)
    s = ranked.Segment(np.arange(n), np.zeros(n, bool), tf.sum(1), np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n), tf.ravel().astype(np.int64), n, int(tf.sum()))
    scored, whole = [], s.scores
    s.scores = lambda docs, weight: scored.append(len(docs)) or whole(docs, weight)
    best, w = ranked.Best(10), np.array([5, 7])
    s.search(np.array([0, 1]), w, w, best)
    every = whole(np.arange(n), w)
    assert best.score.tolist() == np.sort(every)[::-1][:10].tolist() and sum(scored) < n / 4 and not s.seen.any()


def test_odd_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha beta word"), (2, "one")], "item_id long, text string")
    rows = ranked.search(odd, items).collect()
    assert [r.doc_id for r in rows if r.item_id == 2] == [7] and {r.doc_id for r in rows if r.item_id == 1} >= {1, 2, 3, 9}
    assert ranked.search(empty, items).count() == 0 and ranked.search(odd, items.where("false")).count() == 0
    assert ranked.search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]

import random
from hashlib import sha256

from tidemark.llm import decontaminate as d

WORDS = ["w%d" % i for i in range(6)]


def brute(text, items, window=13):
    words = d.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        w = d.words_of((t or "").encode())
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add("" if item is None else str(item))
    n = len(hit)
    return len(words), n, len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(words)


def test_against_brute_force(spark, odd, empty):
    draw = random.Random(1)
    text = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    items = [(2, text(30)), (10, text(13)), (3, text(4)), (3, text(14)), (4, None), (5, ""), (6, "one"), (None, text(5))]
    docs = [(i, text(draw.randrange(0, 200))) for i in range(60)] + [(100, items[0][1].upper().replace(" ", "-")), (101, None), (102, ""), (103, "one"), (103, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = sorted((i, *brute(t, items)) for i, t in docs)
    assert sorted(map(tuple, d.find_hits(df, bench).collect())) == expected
    assert sorted(map(tuple, d.find_hits(df, bench, block_words=150).collect())) == expected
    keep = sorted(i for i, *r in expected if not r[-1])
    assert sorted(r.doc_id for r in d.keep_clean(df, bench).collect()) == keep
    assert sorted(r.doc_id for r in d.keep_clean(df, bench, block_words=150).collect()) == keep
    assert d.find_hits(odd, bench).count() == odd.count()
    assert d.find_hits(empty, bench).count() == 0 and d.find_hits(df, bench.where("false")).where("n_hit > 0").count() == 0
    assert d.keep_clean(odd, bench).columns == odd.columns


def test_keep_clean_judges_rows_whatever_the_number_of_blocks(spark):
    items = [(1, " ".join(f"a{i}" for i in range(30))), (2, " ".join(f"b{i}" for i in range(30)))]
    docs = [(None, items[0][1]), (None, "clean without an id"), (7, items[1][1]), (7, "clean, though its id is not"), (8, "clean"), (8, "clean")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    kept = [sorted(((r.doc_id or 0), r.text) for r in d.keep_clean(df, bench, block_words=n).collect()) for n in (4_000_000, 400)]
    assert kept[0] == kept[1] == sorted((i or 0, t) for i, t in docs if t.startswith("clean"))


def test_rows_are_judged_alike_for_any_block_size(spark):
    """Null and repeated ids, with contaminated and clean texts of one id."""
    draw = random.Random(6)
    items = [(k, " ".join(f"q{draw.randrange(10**6)}" for _ in range(20))) for k in range(12)]
    clean = lambda: " ".join(f"c{draw.randrange(10**6)}" for _ in range(40))
    docs = [(None, items[0][1]), (None, clean()), (7, items[3][1]), (7, clean()), (7, clean()), (8, items[11][1] + " end"), (9, clean()), (9, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(((i, t) for i, t in docs if not brute(t, items)[-1]), key=str)
    for size in (100, 150, 400, 1000, 4_000_000):
        assert sorted(map(tuple, d.keep_clean(df, bench, block_words=size).collect()), key=str) == expected
        found = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.find_hits(df, bench, block_words=size).collect()), key=str)
        assert found == sorted(((i, *brute(t, items)) for i, t in docs), key=str)

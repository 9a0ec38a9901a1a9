import random
from collections import Counter

from test_words import thue_morse
from tidemark.llm import near_duplicates as n
from tidemark.llm import words


def test_registers_agree_as_often_as_the_similarity_says():
    draw = random.Random(5)
    for share in (0.3, 0.6, 0.9):
        a = [f"x{draw.randrange(10**9)}" for _ in range(600)]
        b = [w if draw.random() < share ** (1 / n.SHINGLE) else f"y{draw.randrange(10**9)}" for w in a]
        b += b[:100]  # repeated shingles weigh more
        w = words.Words([" ".join(a).encode(), " ".join(b).encode()])
        text, shingle, count = n.shingles(w)
        win = n.signatures(text, shingle, count.astype(float), 2, 4096)
        exact = n.probability_jaccard(*(n.shingle_counts(" ".join(x).encode()) for x in (a, b)))
        assert abs((win[0] == win[1]).mean() - exact) < 0.04


def test_exact_similarity():
    s = Counter
    a, b = {1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}
    assert n.probability_jaccard(s(a), s(b)) == 0.5 and n.probability_jaccard(s(), s()) == n.probability_jaccard(s(a), s()) == 0
    assert abs(n.probability_jaccard(s({1: 2, 2: 4}), s({1: 1, 2: 2})) - 1) < 1e-12  # scale doesn't matter
    a, b = {1: 3, 2: 1, 5: 2}, {1: 1, 2: 4, 6: 1}
    every = {1, 2, 5, 6}
    brute = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in (1, 2))
    assert abs(n.probability_jaccard(s(a), s(b)) - brute) < 1e-12


def test_classes(spark, odd, empty):
    draw = random.Random(2)
    base = [f"v{draw.randrange(10**6)}" for _ in range(200)]
    docs = [(100, " ".join(base))]
    for i in range(40):  # copies with two changed words, less alike among themselves than to the original
        w = list(base)
        for k in draw.sample(range(200), 2):
            w[k] = f"z{i}{k}"
        docs.append((101 + i if i % 2 else 50 + i, " ".join(w)))
    docs += [(300 + i, " ".join(f"u{draw.randrange(10**6)}" for _ in range(100))) for i in range(20)]
    docs += [(400, docs[-1][1]), (401, None), (402, None), (403, ""), (404, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in n.classes(df).collect()}
    assert len(rows) == len(docs)
    near = [i for i, _ in docs if i < 300]
    assert {rows[i].class_id for i in near} == {min(near)}
    assert all(rows[300 + i].class_id == 300 + i for i in range(20)) and rows[400].class_id == 319 and rows[400].n_copies == 2
    assert rows[401].class_id == 401 and rows[402].class_id == 402 and rows[404].class_id == 403
    kept = {r.doc_id for r in n.keep_first(df).collect()}
    assert kept == {min(near), *range(300, 320), 401, 402, 403}
    odd_rows = n.classes(odd)
    assert odd_rows.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert {r.doc_id: r.class_id for r in odd_rows.collect()}[3] == 1
    assert n.classes(empty).count() == 0 and n.keep_first(odd).columns == odd.columns


def test_pairs_of_a_family_without_an_original(spark):
    """All texts mutually a little under the threshold, with pairs over it: no leader stands for its bucket."""
    draw = random.Random(7)
    base, docs = [f"q{draw.randrange(10**9)}" for _ in range(4000)], []
    for p in range(24):
        at = draw.sample(range(5, 4000, 5), 88)
        for half in (at[12:50], at[50:]):
            w = list(base)
            for k in at[:12]:
                w[k] = f"shared{p}_{k}"
            for k in half:
                w[k] = f"own{p}_{k}"
            docs.append((len(docs), " ".join(w)))
    parts = [n.shingle_counts(t.encode()) for _, t in docs]
    root, linked, apart = list(range(len(docs))), 0, 0
    for i in range(len(docs)):
        for j in range(i):
            if n.probability_jaccard(parts[i], parts[j]) >= 0.8:
                linked += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
            else:
                apart += 1
    assert linked == 24 and apart > 1000
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    before = n.TILE
    try:
        n.TILE = 8  # buckets of several tiles
        assert {r.doc_id: r.class_id for r in n.classes(df).collect()} == dict(enumerate(root))
    finally:
        n.TILE = before


def brute(docs):
    """class_id and n_links of every (doc_id, text), by all pairs."""
    least, out = {}, []
    for i, t in docs:
        if i is not None and t is not None:
            least[t] = min(least.get(t, i), i)
    texts = list(least)
    parts, root, links = [n.shingle_counts(t.encode()) for t in texts], list(range(len(texts))), Counter()
    for i in range(len(texts)):
        for j in range(i):
            if n.probability_jaccard(parts[i], parts[j]) >= 0.8:
                links.update((i, j))
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    name = {t: min(least[u] for u, r in zip(texts, root, strict=True) if r == root[i]) for i, t in enumerate(texts)}
    for i, t in docs:
        out.append((i, name[t]) if i is not None and t is not None else (i, i))
    return out


def test_classes_against_all_pairs(spark):
    """Families at every likeness around the threshold, with repeated ids of other texts, copies, nulls."""
    draw, docs = random.Random(13), []
    for _ in range(25):
        base = [f"a{draw.randrange(10**6)}" for _ in range(draw.randrange(60, 300))]
        for _ in range(draw.randrange(1, 10)):
            w = list(base)
            for k in draw.sample(range(len(w)), draw.randrange(0, max(2, len(w) // 18))):
                w[k] = f"b{draw.randrange(10**6)}"
            docs.append((draw.randrange(80), " ".join(w)))
    docs += [draw.choice(docs) for _ in range(10)] + [(None, docs[0][1]), (7, None), (8, ""), (9, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is not None, *map(lambda x: x or 0, r))
    # equal rows of one id and text are one document
    rows = n.classes(df).collect()
    assert len(rows) == len({(i, t) for i, t in docs if i is not None and t is not None}) + 2
    got = sorted({(r.doc_id, r.class_id) for r in rows}, key=key)
    assert got == sorted(set(brute(docs)), key=key)
    kept = sorted(((r.doc_id, r.text) for r in n.keep_first(df).collect()), key=lambda r: (r[0] or -1, r[1] or ""))
    assert kept == sorted((d for d, (_, c) in zip(docs, brute(docs), strict=True) if d[0] is None or c >= d[0]), key=lambda r: (r[0] or -1, r[1] or ""))


def test_words_that_defeat_a_power_sum(spark):
    """Five words each, one shingle: alike only if all words are."""
    docs = []
    for size in (2048, 4096):
        for x in (thue_morse(size), thue_morse(size, "b", "a"), thue_morse(size, "b", "c")):
            docs.append((len(docs), f"p q r s {x}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in n.classes(df).collect())

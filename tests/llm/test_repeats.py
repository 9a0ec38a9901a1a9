import random
from hashlib import sha256

import pytest
from test_words import thue_morse
from tidemark.llm import repeats


def brute(docs, window=13):
    first, out = {}, []
    words = [(t or "").encode().split() for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    for (i, _), w in zip(docs, words, strict=True):
        mask = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                mask[k : k + window] = b"\1" * window
        out.append((i, len(w), sum(mask), sha256(b" ".join(x for x, m in zip(w, mask, strict=True) if not m)).hexdigest()))
    return out


KEY = lambda r: (r[0] is not None, r[0] or 0, r[1:])


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_against_brute_force(spark, alphabet):
    draw = random.Random(alphabet)
    text = lambda n: [f"w{draw.randrange(alphabet)}" for _ in range(n)]
    pool = [text(draw.randrange(10, 40)) for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(draw.randrange(0, 5)):
            w += draw.choice(pool) if draw.random() < 0.5 else text(draw.randrange(0, 20))
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, repeats.remove_repeats(df).collect())) == sorted(brute(docs))


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, repeats.remove_repeats(odd).collect()), key=KEY) == sorted(brute(docs), key=KEY)
    assert repeats.remove_repeats(empty).count() == 0
    kept = {r.doc_id: r.kept for r in repeats.remove_repeats(odd, with_text=True).collect()}
    assert kept[2] == "end" and kept[3] == "" and kept[7] == "one"


def test_words_that_defeat_a_power_sum(spark):
    draw, docs = random.Random(4), []
    for n in (2048, 4096):
        rest = [f"u{draw.randrange(10**6)}" for _ in range(12)]
        docs += [(len(docs), " ".join([thue_morse(n), *rest])), (len(docs) + 1, " ".join([thue_morse(n, "b", "a"), *rest])), (len(docs) + 2, " ".join([thue_morse(n), *rest, "end"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, repeats.remove_repeats(df).collect()))
    assert got == sorted(brute(docs)) and [r[2] for r in got] == [0, 0, 13, 0, 0, 13]


def test_long_repeats_with_changes(spark):
    """Near copies, cut-outs and passages across documents: high blocks, anchors and windows all take part."""
    draw = random.Random(9)
    word = lambda: f"v{draw.randrange(500)}"
    base, docs = [[word() for _ in range(400)] for _ in range(4)], []
    for i in range(60):
        w = list(draw.choice(base))
        for _ in range(draw.randrange(0, 6)):
            w[draw.randrange(len(w))] = word()
        a, b = sorted(draw.sample(range(len(w) + 1), 2))
        docs.append((draw.randrange(50), "\t".join(w[a:b] if draw.random() < 0.5 else w) + " \n"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, repeats.remove_repeats(df).collect())) == sorted(brute(docs))


def test_equal_hashes_of_all_words(spark, monkeypatch):
    """Hashes only find candidates: with two values for all words the result is the same."""
    real = repeats.words.span_hashes
    draw = random.Random(11)
    docs = [(i, " ".join(f"w{draw.randrange(3)}" for _ in range(draw.randrange(10, 40)))) for i in range(30)]
    monkeypatch.setattr(repeats.words, "span_hashes", lambda *a: real(*a) & repeats.U(1))
    texts, window = [t.encode() for _, t in docs], 13
    first = {}
    for k, t in enumerate(texts):
        p = repeats.Parsed([t], window)
        for name in map(tuple, p.names(p.at, p.at + window).tolist()):
            first.setdefault(name, k)
    w = [t.split() for t in texts]
    assert len(first) == len({tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1)})

import random
import re

from pyspark.sql import functions as F
from tidemark.llm import licenses as lic

EVERY = lic.PHRASES + lic.NOTICES


def words(t):
    return re.findall(lic.WORD, (t or "").translate(str.maketrans(lic.UPPER, lic.LOWER)))


def brute(text, templates):
    w = words(text)
    places, labels, base, score = [], set(), set(), 0.0
    for t in templates:
        n, s = len(t.words), set(t.words)
        if t.phrase:
            here = [i for i in range(len(w) - n + 1) if w[i : i + n] == t.words]
            if here:
                places += here
                labels.add(t.label)
                base.add(t.label)
                score = 1.0
            continue
        for k in range(0, max(len(w), 1), lic.STRIDE):
            common = len(s & set(w[k : k + 2 * lic.STRIDE]))
            if 100 * common >= t.percent * len(s):
                labels.add(t.label)
                score = max(score, common / len(s))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def same(df, templates=EVERY):
    expected = sorted(((r.doc_id, *brute(r.text, templates)) for r in df.collect()), key=str)
    assert sorted(map(tuple, lic.scan(df, templates).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=str) == expected


def test_notices_phrases_and_odd_tables(spark, odd, empty):
    draw = random.Random(3)
    filler = lambda n: " ".join(draw.choice(["the", "of", "copy", "software", "license", "mit", "apache", "public", "general", "zu", "ra"]) for _ in range(n))
    texts = [None, "", "MIT-License", "mit\nlicense mit license", "MITKLicense", "general public, license", "a general. public LICENSE_v2", "mit-licensed"]
    for t in lic.NOTICES:
        cut = t.text.split()
        texts += [t.text.upper(), " ".join(cut[: len(cut) * 3 // 4]), filler(60) + " " + t.text + " " + filler(70), filler(120) + " " + " ".join(cut[2:])]
    texts += [filler(draw.randrange(0, 400)) for _ in range(40)] + ["mit license " * 4000, "x " * 63 + "mit license", "x " * 127 + "general public license"]
    df = spark.createDataFrame([(i // 2, t, "row", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, row long")
    same(df.repartition(3))
    same(odd)
    assert lic.scan(empty).count() == 0
    assert lic.scan(empty).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_filters_lose_no_pair(spark):
    """Random templates and blocks around every threshold."""
    draw = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)]
    templates = tuple(lic.Template(f"t{k}", " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 12))), draw.choice([1, 30, 50, 80, 100])) for k in range(12))
    texts = [" ".join(draw.choice(vocabulary[: draw.randrange(2, 31)] + ["z"] * 20) for _ in range(draw.randrange(0, 300))) for _ in range(80)]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates)


def test_blocks_hold_the_places(spark):
    text = "x " * 70 + "mit license " + "x " * 300 + "apache license"
    rows = lic.find_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("block is not null").collect()
    assert sorted((r.label, r.block, tuple(r.starts)) for r in rows) == [("apache", 5, (372,)), ("mit", 1, (70,))]


def test_plan_moves_no_text(spark, odd):
    plan = lic.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct|NestedLoop", plan)
    moved = [s for s in plan.splitlines() if "Exchange hashpartitioning" in s]
    assert len(moved) == 1
    assert lic.find_blocks(odd).where(F.col("block").isNotNull() & (F.col("share") > 1)).count() == 0

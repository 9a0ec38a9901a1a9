import random

import numpy as np

from tidemark.llm import quality as q

GOOD = [f"plain{i}" for i in range(400)]


def corpus(n, seed):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [draw.choice(GOOD) for _ in range(draw.randrange(30, 300))]
        kind = i % 6
        if kind == 0:
            w[draw.randrange(len(w))] = draw.choice(["vile", "filth"])
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 0 if kind == 1 else 1, int(kind == 0)))
    return docs, labels


def test_grades_held_out(spark, odd, empty):
    docs, labels = corpus(1800, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([*labels[:1200], labels[0], (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = q.train(df, lab, sample_rows=1100)
    assert model.thresholds[0] < model.thresholds[1]
    rows = {r.doc_id: r for r in q.score_documents(df, model).collect()}
    held = range(1200, 1800)
    assert sum(rows[i].keep for i in held if i % 6 > 1) / 400 > 0.99
    assert sum(not rows[i].keep for i in held if i % 6 <= 1) / 200 > 0.97
    assert rows[1200].expected_grade < rows[1202].expected_grade
    kept = {r.doc_id for r in q.keep_good(df, model).collect()}
    assert kept == {i for i, r in rows.items() if r.keep}
    odd_rows = {r.doc_id: r for r in q.score_documents(odd, model).collect()}
    assert odd_rows[4].keep and odd_rows[4].tail_probability is None and odd_rows[5].keep and odd_rows[6].keep
    assert q.keep_good(odd, model).columns == odd.columns and q.score_documents(empty, model).count() == 0
    nothing = q.train(df, lab.where("false"))
    assert nothing is None and q.keep_good(df, nothing).count() == df.count()


def likelihood(params, x, grade):
    """Mean negative log-likelihood of grades by the definition: P(grade <= k) = 1 / (1 + exp(s - t_k))."""
    t0, t1 = params[0], params[0] + np.exp(params[1])
    s = x @ params[2:]
    below = [np.zeros(len(s)), 1 / (1 + np.exp(s - t0)), 1 / (1 + np.exp(s - t1)), np.ones(len(s))]
    p = np.array([below[g + 1][i] - below[g][i] for i, g in enumerate(grade)])
    return -np.log(p).mean()


def test_fit_reaches_the_greatest_likelihood():
    """Without a penalty the fit is the maximum that plain descent on the written-out likelihood finds."""
    random_ = np.random.default_rng(2)
    x = (random_.random((500, 3)) < [0.5, 0.4, 0.6]).astype(float)
    score = x @ [1.5, -1.0, 0.4] + random_.logistic(size=500)
    grade = np.digitize(score, [-0.5, 1.0])
    best = np.zeros(5)
    for k in range(600):
        slope = np.array([(likelihood(best + d, x, grade) - likelihood(best - d, x, grade)) / 2e-5 for d in np.eye(5) * 1e-5])
        best -= (1.5 if k < 400 else 0.5) * slope
    model = q.fit([np.flatnonzero(r) for r in x], grade, steps=6000, rate=0.3, penalty=0.0, batch=250, least_df=1)
    found = np.array([model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0]), *model.weights[:3]])
    assert likelihood(found, x, grade) < likelihood(best, x, grade) + 2e-3
    assert np.abs(found - best).max() < 0.15
    rows = np.repeat(np.arange(500), x.sum(1).astype(int)), np.concatenate([np.flatnonzero(r) for r in x])
    tails = model.tails(model.scores(rows[0], rows[1], 500))
    assert np.abs(tails - 1 / (1 + np.exp(model.thresholds - (x @ found[2:])[:, None]))).max() < 1e-9


def test_repeated_ids_reach_the_driver_once(spark):
    """A doc_id that stands a thousand times is one row of the sample, with its least text."""
    docs, labels = corpus(300, 9)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(2, "zzz later text")] * 1000 + [(5, docs[5][1])] * 1000, "doc_id long, text string")
    one, two = q.train(df, lab), q.train(df.unionByName(more), lab)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.thresholds, two.thresholds)

import numpy as np
from tidemark.llm import neighbours as n


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for i, v in good:
        if i is not None and i % every == 0:
            d = sorted((float(n.exact_distances(v[None], w[None])[0]), j) for j, w in good if j != i and j is not None)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(d)]
    return sorted(out)


def test_hilbert_places_are_a_path():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(np.ndindex(*[1 << bits] * dims)))
        at = n.hilbert(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_against_brute_force(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0]), (2006, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(map(tuple, n.nearest(df, every=20, k=10).collect()))
    assert got == brute(rows, 20, 10)
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, n.nearest(few, every=2, k=10).collect())) == brute(rows[:5], 2, 10)
    assert n.nearest(df.where("false")).count() == 0
    wide = {(r.query_id, r.vec_id) for r in n.nearest(df, every=20, k=10, window=60, exact=False).collect() if r.query_id < 300}
    exact = {(q, v) for q, _, v, _ in got if q < 300}
    assert len(wide & exact) / len(exact) > 0.6


def test_an_id_that_stands_very_often_near_a_query_counts_once(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.standard_normal(8).tolist()) for i in range(200)]
    rows += [(777, (np.array(rows[q][1]) + 0.01 * random.standard_normal(8)).tolist()) for q in (0, 100) for _ in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    expected = {}
    for q in (0, 100):
        least = {}
        for j, w in rows:
            if j != q:
                least[j] = min(least.get(j, 9e9), float(n.exact_distances(np.array([rows[q][1]]), np.array([w]))[0]))
        expected[q] = [j for _, j in sorted((s, j) for j, s in least.items())][:10]
    got = n.nearest(df, every=100, k=10, window=400).orderBy("query_id", "rank").collect()
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in expected} == expected
    # the windows alone, which hold all rows here
    alone = n.nearest(df, every=100, k=10, window=1000, exact=False).orderBy("query_id", "rank").collect()
    assert {q: [r.vec_id for r in alone if r.query_id == q] for q in expected} == expected
    # a task that trims what it holds: all rows are in reach
    rows_of, dim = n.valid_vectors(df, "vec_id", "embedding")
    turn = n.directions(dim)
    blocks = n._blocks(n._ordered(rows_of, turn, *n._bounds(rows_of, turn)), turn)
    found = n._checked(blocks.coalesce(1), [(q, rows[q][1], 1e150) for q in expected], turn, dim, 10, hold=100)
    top = n._top(found, 10).orderBy("query_id", "rank").collect()
    assert {q: [r.vec_id for r in top if r.query_id == q] for q in expected} == expected

import importlib
from hashlib import sha256

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "pieces"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, n = docs.columns, docs.count()
    from tidemark.llm.common import Scratch

    scratch = Scratch(spark, "p")
    for name, stage in p.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, DATA), name)
        assert docs.columns == names
        now = docs.count()
        assert now == n if name == "secrets" else 0 < now <= n
        n = now
    out = p.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == n and out.select("doc_id").distinct().count() == n
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{12,}")).count() == 0


def test_registered():
    e = importlib.import_module("__spark_entry__")
    names = e.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 11))


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows, clashing column names: every stage keeps the columns, copies go, clean rows stay."""
    import corpus_pipeline as p
    from tidemark.llm import common

    for docs, expected in ((odd, None), (empty, 0)):
        scratch, names = common.Scratch(spark, "odd"), docs.columns
        for name, stage in p.STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, DATA), name)
            assert docs.columns == names
        rows = docs.select("doc_id", "text").collect()
        last = p.STAGES[-1][1](spark, docs, DATA)
        assert last.count() == len(rows)
        if expected is not None:
            assert len(rows) == expected
        else:
            # without words nothing is judged; copies of 1 and 5 go, near copies too (2 of 1)
            ids = [r.doc_id for r in rows]
            assert {4, 5} <= set(ids) and 6 in ids and not {2, 3} & set(ids) and len(ids) == len(set(ids))


def test_run_against_brute_force(spark):
    """All stages over a whole small table: after the classifier's decisions, all pairs, all windows, plain regular expressions and the library."""
    import corpus_pipeline as p
    import sentencepiece
    import test_decontaminate
    import test_near_duplicates
    import test_secrets
    from tidemark.llm import common, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r.doc_id for r in quality.score_documents(docs, model).collect() if r.keep}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    rows = [d for d, (_, c) in zip(rows, test_near_duplicates.brute(rows), strict=True) if c >= d[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [d for d in rows if not test_decontaminate.brute(d[1], items)[-1]]
    library, expected = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_file("piece_bpe_32k.model")), []
    for i, t in rows:
        clean, at = "", 0
        for a, _, b in test_secrets.brute(t or "")[1]:
            if b > at:
                clean += t[at : max(a, at)] + ("[SECRET]" if a >= at else "")
                at = b
        ids = library.encode(clean + (t or "")[at:])
        expected.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    assert len(expected) > 50 and sorted(map(tuple, p.run(spark, DATA).collect())) == sorted(expected)

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_words import thue_morse
from tidemark.llm import common, token_codes

PATH = common.tokenizer_file("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=2000), st.integers(0, 2000), st.integers(0, 2000))
def test_any_range_is_read_back(tmp_path_factory, ids, a, b):
    folder = str(tmp_path_factory.mktemp("dac"))
    ids = np.array(ids, np.uint32)
    common.write_file(folder, "x.dac", token_codes.file_parts(np.array([1]), np.array([len(ids)]), ids), 0)
    f = token_codes.DacFile(f"{folder}/x.dac")
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert f.tokens_between(a, b).tolist() == ids[a:b].tolist()
    if a < len(ids):
        assert f.token(a) == ids[a]


def test_tokenizer_agrees_with_the_library(odd):
    coder = token_codes.WordTokenizer(PATH)
    texts = [r.text or "" for r in odd.collect()] + [f"{thue_morse(n)} {thue_morse(n, 'b', 'a')}" for n in (2048, 4096)] + ["İ Σας\x1cx", "a\x01b", "don't 'S''s --##", "é ﻿"]
    expected = [e.ids for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode([t.encode() for t in texts])] == expected


def test_documents_round_trip(spark, odd, empty):
    scratch = common.Scratch(spark, "t")
    files = token_codes.write_token_files(odd, scratch.path("dac"), PATH, 2, file_tokens=50)
    assert len(files) > 4 and all(f["tokens"] >= 50 or f["docs"] for f in files)
    got = [tuple(r) for r in token_codes.read_token_files(spark, files).collect()]
    coder = token_codes.WordTokenizer(PATH).library
    rows = sorted(odd.select("doc_id", "text", F.xxhash64("text").alias("tag")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tag))
    start, expected = 0, []
    for r in rows:
        ids = coder.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == expected
    assert token_codes.read_token_files(spark, token_codes.write_token_files(empty, scratch.path("none"), PATH, 2)).count() == 0


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"12345678")
    with pytest.raises(ValueError):
        token_codes.DacFile(str(tmp_path / "x"))

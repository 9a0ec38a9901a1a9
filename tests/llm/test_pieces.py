import random
from hashlib import sha256

import sentencepiece
from test_words import thue_morse
from tidemark.llm import common, pieces

PATH = common.tokenizer_file("piece_bpe_32k.model")


def test_agenda_agrees_with_the_library():
    coder, library = pieces.PieceTokenizer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    draw = random.Random(3)
    texts = ["", " ", "\n", "a▁b ▁ c", "  lead", "trail  ", "x\x00y", "thththe" * 40, ("abtheing" * 30 + " e") * 9]
    texts += ["".join(draw.choice(" ab\n▁é漢.,  the in\t") for _ in range(50)) for _ in range(500)]
    texts += [f"{thue_morse(n)} {thue_morse(n, 'b', 'a')}" for n in (2048, 4096)]
    out, back = [], []
    for ids, ends in coder.encode([t.encode() for t in texts]):
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        back += [bytes(x).decode() for x in coder.decode(ids, ends)]
    assert out == library.encode(texts)
    assert back == [library.decode(x) for x in out]


def test_short_and_long_agendas_agree():
    coder = pieces.PieceTokenizer(PATH, check=False)
    for text in ("▁thing", "ananananan", "▁▁▁▁▁▁▁", "zzzzqqé漢"):
        assert coder._short(text) == coder._long(text)


def test_documents(spark, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    expected = []
    for r in odd.collect():
        ids = library.encode(r.text or "")
        expected.append((r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda x: (x[0] or -1, x[2])
    assert sorted(map(tuple, pieces.digest_documents(odd, PATH).collect()), key=key) == sorted(expected, key=key)
    assert pieces.encode_documents(odd, PATH).count() == odd.count()
    assert pieces.digest_documents(empty, PATH).count() == 0

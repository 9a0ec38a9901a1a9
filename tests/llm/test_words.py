import random

import numpy as np
from tidemark.llm import words


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    """The first n letters; with its complement it defeats any power sum modulo 2**64 from 2,048 on."""
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


def test_hashes_follow_bytes():
    texts = [b"one two one", b"two", b"x" * 63 + b" " + b"x" * 64 + b" " + b"x" * 65 + b" " + b"x" * 65]
    w = words.Words(texts)
    raw = [bytes(w.buf[a:b]) for a, b in zip(w.first, w.last, strict=True)]
    for i, a in enumerate(raw):
        for j, b in enumerate(raw):
            assert (w.hash[i] == w.hash[j]) == (a == b)


def test_words_that_defeat_a_power_sum():
    for n in (2048, 4096):
        w = words.Words([f"{thue_morse(n)} {thue_morse(n, 'b', 'a')}".encode()])
        assert w.hash[0] != w.hash[1]


def test_memo_holds_bytes_not_hashes(monkeypatch):
    """With four hash values for all spans every lookup still gives what its own bytes gave."""
    real = words.span_hashes
    monkeypatch.setattr(words, "span_hashes", lambda *a: real(*a) & words.U(3 << 62))
    draw, memo, asked = random.Random(1), words.Memo(np.uint32, 300, 20_000), []

    def learn(new):
        asked.extend(new)
        lists = [list(x) for x in new]
        return np.array([v for x in lists for v in x], np.uint32), np.array([len(x) for x in lists])

    for _ in range(20):
        text = " ".join("ab"[draw.random() < 0.5] * draw.choice([1, 2, 7, 8, 9, 64, 65, 200]) + str(draw.randrange(20)) for _ in range(400)).encode()
        buf, _ = words.joined([text])
        first, last = words.spans(buf)
        got, n = memo.values(buf, first, last, learn)
        expected = text.split()
        assert bytes(got.astype(np.uint8)) == b"".join(expected) and n.tolist() == [len(x) for x in expected]
    assert len(asked) < 20 * 400

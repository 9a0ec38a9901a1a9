"""Words of whole texts in NumPy: spans in UTF-8 bytes, 64-bit hashes of spans, and a bounded memo from spans to values."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Spans of more bytes are hashed and compared by the byte string, not eight bytes at a time.
LONG = 64
#: What is left of eight bytes when only the first k count.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64's published constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """B**i and B**-i modulo 2**64, as far as they were needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, U)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U))
        return self.up, self.down


_POWERS = Powers(BASE)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[k] * B**k over i <= k < j."""
    up, _ = _POWERS.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] that does not depend on where they stand.

    For filters only: long ranges can be made to collide, so whoever acts on equal hashes compares what was hashed.
    """
    _, down = _POWERS.upto(len(sums))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U) * U(0xD6E8FEB86659FD93))


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on (zeros beyond its end), as one number each."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """Hashes of spans, mixed after every eight bytes; long spans by blake2b.  Equal hashes don't prove equal bytes."""
    view = eights(buf) if view is None else view
    n = (last - first).astype(np.int64)
    h = mix(n.astype(U) * U(0xD6E8FEB86659FD93) + BASE)
    live, at = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(live):
        rest = n[live] - at
        h[live] = mix((h[live] ^ (view[first[live] + at] & FIRST_BYTES[np.minimum(rest, 8)])) * U(0x9FB21C651E98DF25))
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(blake2b(buf[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def spans(buf: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separator[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def groups(texts: list[bytes], size: int = (1 << 20) - 64):
    """(first, last) of consecutive texts of together about ``size`` bytes, one at least."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > size:
            yield first, i
            first, n = i, 0
        n += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes], by: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """One buffer with the texts, each followed by ``by`` (one byte), and where each text begins (and the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(by.join([*texts, b""]), np.uint8), at


class Words:
    """The words of a group of texts: spans in one buffer, and hashes."""

    def __init__(self, texts: list[bytes], separator: np.ndarray = SPACE):
        self.buf, self.text_at = joined(texts)
        self.first, self.last = spans(self.buf, separator)
        #: index of each text's first word; one more for the end
        self.doc_at = np.searchsorted(self.first, self.text_at)
        self.hash = span_hashes(self.buf, self.first, self.last)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_at)


def gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[at[0] : at[0] + n[0]], pool[at[1] : ...], ... as one array."""
    n = n.astype(np.int64)
    total = int(n.sum())
    if not total:
        return pool[:0]
    index = np.repeat(at - (np.cumsum(n) - n), n)
    index += np.arange(total)
    return pool[index]


class Memo:
    """From a span's bytes to a slice of a pool of numbers.  A slot is found by hash and holds only if its bytes are the span's.

    Bounded by ``limit`` spans and ``size_limit`` bytes of spans and of values: beyond either all is forgotten.
    """

    def __init__(self, dtype, limit: int = 400_000, size_limit: int = 24 << 20):
        self.dtype, self.limit, self.size_limit = dtype, limit, size_limit
        self.bits = (2 * limit).bit_length()
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.key = np.zeros(size, U)
        #: where its values and its bytes begin in their pools (-1: a free slot), and how many there are
        self.at, self.n = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.raw_at, self.raw_n = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0
        self.raw, self.raw_used = np.zeros(1 << 20, np.uint8), 0
        self.size = 0

    def _same(self, slot: np.ndarray, view: np.ndarray, buf: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether slots hold the bytes of spans."""
        ok = self.raw_n[slot] == n
        pool = np.ndarray(len(self.raw) - 8, "<u8", self.raw, strides=(1,))
        live, at = np.flatnonzero(ok & (n <= LONG)), 0
        while len(live):
            rest = n[live] - at
            equal = (view[first[live] + at] ^ pool[self.raw_at[slot[live]] + at]) & FIRST_BYTES[np.minimum(rest, 8)] == 0
            ok[live[~equal]] = False
            live, at = live[equal & (rest > 8)], at + 8
        for i in np.flatnonzero(ok & (n > LONG)).tolist():
            a, b = int(first[i]), int(self.raw_at[slot[i]])
            ok[i] = np.array_equal(buf[a : a + n[i]], self.raw[b : b + n[i]])
        return ok

    def find(self, h: np.ndarray, view: np.ndarray, buf: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The slot of each span, -1 where it is unknown."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        out, rest = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(rest):
            s = slot[rest]
            used, alike = self.at[s] >= 0, np.flatnonzero((self.key[s] == h[rest]) & (self.at[s] >= 0))
            hit = np.zeros(len(rest), bool)
            hit[alike] = self._same(s[alike], view, buf, first[rest[alike]], n[rest[alike]])
            out[rest[hit]] = s[hit]
            rest = rest[used & ~hit]
            slot[rest] = (slot[rest] + 1) & mask
        return out

    def _room(self, values: int, raw: int) -> None:
        if self.used + values > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(values, len(self.pool)), self.dtype)])
        if self.raw_used + raw + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw[: self.raw_used], np.zeros(max(raw + 8, len(self.raw)), np.uint8)])

    def add(self, h: np.ndarray, buf: np.ndarray, first: np.ndarray, size: np.ndarray, values: np.ndarray, n: np.ndarray) -> None:
        """Put in new spans of distinct hashes, with their values end to end."""
        raw = gather(buf, first, size)
        self._room(len(values), len(raw))
        self.pool[self.used : self.used + len(values)] = values
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        n = np.asarray(n, np.int64)
        at, raw_at = self.used + np.cumsum(n) - n, self.raw_used + np.cumsum(size) - size
        self.used, self.raw_used, self.size = self.used + len(values), self.raw_used + len(raw), self.size + len(h)
        mask = np.int64((1 << self.bits) - 1)
        slot, rest = (h >> U(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(rest):
            s = slot[rest]
            free = self.at[s] < 0
            _, one = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            one = one[free[one]]
            won, s = rest[one], s[one]
            self.key[s], self.at[s], self.n[s], self.raw_at[s], self.raw_n[s] = h[won], at[won], n[won], raw_at[won], size[won]
            left = np.ones(len(rest), bool)
            left[one] = False
            rest = rest[left]
            # those whose slot is taken, by others or just now, go one further
            slot[rest] = (slot[rest] + 1) & mask

    def values(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Values of all spans end to end, and how many each has.  ``learn``: from new spans (as bytes) to (values, counts)."""
        if len(first) > self.limit:
            # more than the table holds: part by part
            parts = [self.values(buf, first[i : i + self.limit], last[i : i + self.limit], learn) for i in range(0, len(first), self.limit)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        view, size = eights(buf), (last - first).astype(np.int64)
        h = span_hashes(buf, first, last, view)
        slot = self.find(h, view, buf, first, size)
        new, fresh = np.flatnonzero(slot < 0), False
        while len(new):
            if not fresh and self.size and (self.size + len(new) > self.limit or max(self.raw_used + size[new].sum(), self.pool.itemsize * self.used) > self.size_limit):
                self.clear()
                new = np.arange(len(h))
            fresh = True  # a group of spans that is larger than the bounds is held once
            # one of each hash: a second span of the same hash is still unknown afterwards, and comes next
            _, one = np.unique(h[new], return_index=True)
            one = new[one]
            raw = buf.tobytes()
            self.add(h[one], buf, first[one], size[one], *learn([raw[a:b] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)]))
            slot[new] = self.find(h[new], view, buf, first[new], size[new])
            new = new[slot[new] < 0]
        at, n = self.at[slot].astype(np.int64), self.n[slot]
        return gather(self.pool, at, n), n

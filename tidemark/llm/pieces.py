"""Encoding and decoding with merge-type SentencePiece vocabularies.

Every symbol pair that stands side by side and makes a piece waits on an agenda ordered by score,
the leftmost first among equals; the best is merged and its new neighbours join the agenda, until
none is left.  What is no piece in the end is spelled in byte pieces.  Ids are decoded by the library.

No piece of such a vocabulary has a space mark after another character, and none has a line feed,
so merges never cross those places: a text is the sequence of its segments (a run of spaces with
what follows it; a line feed), and a segment's ids are remembered (within bounds).  Where a
vocabulary does have such pieces, a text is one segment.  In each Arrow batch the segments that
are new are also given to the sentencepiece library, and a difference is an error.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text; rows
with equal doc_id each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = float("inf")


def table_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, where each begins, length)."""
    n = np.array([len(s) for s in strings])
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(n) - n, n


class PieceTokenizer:
    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only merge-type vocabularies with byte fallback, an identity normaliser and a space put in front are covered")
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.cut_space = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.cut_line = not any("\n" in p for p in self.rank)
        self.library, self.check = sentencepiece.SentencePieceProcessor(model_file=path), check
        self.memo = words.Memo(np.uint16 if len(proto.pieces) < 65536 else np.uint32, 500_000)
        self.decimal = table_of([b"%d," % i for i in range(len(proto.pieces))])

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        symbols = self._short(text) if len(text) <= 64 else self._long(text)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            ids = self.ids
            return [x for s in symbols for x in ((ids[s],) if s in ids else [self.byte[b] for b in s.encode()])]

    def _short(self, text: str) -> list[str]:
        """A short text's agenda is a list by place: its least entry, the leftmost among equals, is next."""
        get, none = self.rank.get, NEVER
        symbols = list(text)
        waiting = [get(a + b, none) for a, b in zip(text, text[1:], strict=False)]
        waiting.append(none)
        while (best := min(waiting)) is not none:
            i = waiting.index(best)
            pair = symbols[i] + symbols.pop(i + 1)
            symbols[i] = pair
            del waiting[i]
            if i + 1 < len(symbols):
                waiting[i] = get(pair + symbols[i + 1], none)
            if i:
                waiting[i - 1] = get(symbols[i - 1] + pair, none)
        return symbols

    def _long(self, text: str) -> list[str]:
        rank, symbols = self.rank, list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(r, i, i + 1, pair) for i in range(n - 1) if (r := rank.get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, j, pair = heapq.heappop(waiting)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or after[i] != j or len(a) + len(b) != len(pair):
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(s := pair + symbols[k])) is not None:
                    heapq.heappush(waiting, (r, i, k, s))
            k = before[i]
            if k >= 0 and (r := rank.get(s := symbols[k] + pair)) is not None:
                heapq.heappush(waiting, (r, k, i, s))
        return [s for s in symbols if s is not None]

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        strings, found = [s.decode() for s in new], []
        for s in strings:
            found.append(array("I", self.agenda(s.replace(" ", MARK))))
        if self.check and self.cut_line:
            line = self.byte[10]
            expected = [self.ids[MARK]]
            for ids in found:
                expected += [line, *ids]
            if expected != self.library.encode("\n" + "\n".join(strings), num_threads=1):
                raise RuntimeError("the agenda and the sentencepiece library disagree")
        ids = np.frombuffer(b"".join(map(array.tobytes, found)), np.uint32)
        return ids.astype(self.memo.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def _segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buf, at = words.joined([b" " + t if t else t for t in texts])
        begin = np.zeros(len(buf) + 1, bool)
        if self.cut_space:
            space = buf == 32
            begin[1:-1] = space[1:] & ~space[:-1]
        if self.cut_line:
            line = buf == 10
            begin[:-1] |= line
            begin[1:] |= line
        for k, t in enumerate(texts):
            if MARK.encode() in t:  # a mark of the text's own may merge with spaces: one segment
                begin[at[k] : at[k + 1]] = False
        begin[at[:-1]] = True
        bound = begin.copy()
        stops = at[1:] - 1
        begin[stops], bound[stops] = False, True
        bound[-1] = begin[-1] = False
        pos = np.flatnonzero(bound)
        which = np.flatnonzero(begin[pos])
        return buf, at, pos[which], pos[which + 1]

    def encode(self, texts: list[bytes]):
        """(ids end to end, where each text's begin and the end) for groups of texts in turn."""
        for i, j in words.groups(texts):
            buf, at, first, last = self._segments(texts[i:j])
            ids, n = self.memo.values(buf, first, last, self._learn)
            yield ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, at)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text of each run of ids, by the library."""
        flat = ids.tolist()
        return [t.encode() for t in self.library.decode([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], num_threads=1)]

    def decimals(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each run in decimal, joined by commas."""
        pool, at, n = self.decimal
        raw = memoryview(words.gather(pool, at[ids], n[ids]).tobytes())
        cut = np.concatenate([[0], np.cumsum(n[ids])])[ends]
        return [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One a Python worker: later tasks in it go on with what is remembered."""
    return common.held("pieces", path, lambda: PieceTokenizer(path))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def run(batches):
        coder = piece_tokenizer(model)
        for b in common.slices(batches):
            texts, doc = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], b.column(0)
            done = 0
            for ids, ends in coder.encode(texts):
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc.slice(done, len(found)), found], ["doc_id", "ids"])
                done += len(found)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(common.arrow, run, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and decoded again."""

    def run(batches):
        coder = piece_tokenizer(model)
        for b in common.slices(batches):
            texts, n, one, two = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], [], [], []
            for ids, ends in coder.encode(texts):
                n.append(np.diff(ends))
                one += [sha256(x).hexdigest() for x in coder.decimals(ids, ends)]
                two += [sha256(x).hexdigest() for x in coder.decode(ids, ends)]
            if one:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.transform(common.arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(common.table(spark, sf_dir, "documents"), common.tokenizer_file("piece_bpe_32k.model"))

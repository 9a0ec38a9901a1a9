"""Token ids as directly addressable codes.

A file keeps the ids of consecutive documents split into 8-bit chunks.  Level 0 holds the low
chunk of every id, level k the next chunk of those ids that need more than k chunks.  Each level
but the last has a continuation bitmap (bit i: value i goes on in the next level) and a rank
directory (set bits before each 512-bit block), so any token is found by one chunk, one bit and
one rank a level; no block is decoded.

Layout: magic, header length (uint32), JSON header (counts and byte offsets), then the sections:
doc_ids int64, doc_starts int64 (n_docs + 1), and per level chunks uint8, bitmap uint64, ranks uint64.

A task rolls its files by tokens: it holds the ids of one file (``file_tokens`` and the rest of the
last document), however many documents its range has.

Defined cases: a null text counts as empty; every document ends with ``end_id``; rows with equal
doc_id each keep their own entry, ordered by a hash of the text, so that they may lie in several
tasks; a null doc_id sorts first (kept as a flag); an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

MAGIC = b"TDAC0001"
BLOCK = 512
NULL_ID = -(2**63)
#: A file is closed when it holds so many tokens.
FILE_TOKENS = 16_000_000


# ---------------------------------------------------------------- the code


def encode_levels(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    levels, rest = [], ids
    while True:
        more = rest > 255
        level = {"chunks": rest.astype(np.uint8)}
        if not more.any():
            levels.append(level)
            return levels
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        per = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        level["bitmap"] = bits.view(np.uint64)
        level["ranks"] = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint64)
        levels.append(level)
        rest = rest[more] >> rest.dtype.type(8)


def file_parts(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    sections = [("doc_ids", doc_ids.astype(np.int64)), ("doc_starts", np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))]
    for k, level in enumerate(encode_levels(ids)):
        sections += [(f"{name}{k}", a) for name, a in level.items()]
    where, at = {}, 0
    for name, a in sections:
        where[name] = [at, len(a), str(a.dtype)]
        at += a.nbytes + (-a.nbytes % 8)
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "sections": where}).encode()
    head += b" " * (-(len(head) + 12) % 8)
    parts = [MAGIC, struct.pack("<I", len(head)), head]
    for _, a in sections:
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return parts


class DacFile:
    """Reads single tokens or token ranges of a file; only the bytes that these need are fetched."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        (n,) = struct.unpack("<I", self.file.read(4))
        head = json.loads(self.file.read(n))
        self.base, self.where, self.tokens, self.docs = 12 + n, head["sections"], head["tokens"], head["docs"]
        self.levels = sum(k.startswith("chunks") for k in self.where)
        self.doc_ids, self.doc_starts = self._part("doc_ids"), self._part("doc_starts")

    def _part(self, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        at, n, kind = self.where[name]
        kind, last = np.dtype(kind), n if last is None else min(last, n)
        return np.frombuffer(self.file.read_at((last - first) * kind.itemsize, self.base + at + first * kind.itemsize), kind)

    def tokens_between(self, first: int, last: int) -> np.ndarray:
        """The ids at positions first .. last - 1."""
        out, index, shift = np.zeros(last - first, np.uint32), np.arange(last - first), 0
        for k in range(self.levels):
            if first >= last:
                break
            out[index] |= self._part(f"chunks{k}", first, last).astype(np.uint32) << np.uint32(shift)
            if k + 1 == self.levels:
                break
            block = first // BLOCK
            words = self._part(f"bitmap{k}", block * (BLOCK // 64), -(-last // 64))
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")
            skip = first - block * BLOCK
            before = int(self._part(f"ranks{k}", block, block + 1)[0]) + int(bits[:skip].sum())
            more = bits[skip : skip + last - first].astype(bool)
            index = index[more]
            first, last, shift = before, before + len(index), shift + 8
        return out

    def token(self, i: int) -> int:
        return int(self.tokens_between(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.tokens_between(int(self.doc_starts[k]), int(self.doc_starts[k + 1]))


# ---------------------------------------------------------------- the tokenizer


class WordTokenizer:
    """Ids of whole texts, with a bounded memory of what chunks gave.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are
    those of its space-separated chunks in turn.  New chunks of printable ASCII and Latin letters
    are normalised by lower-casing alone and go to the library many at a time, a mark between them;
    any other chunk goes to the full tokenizer by itself.
    """

    BREAKS = np.zeros(256, bool)
    BREAKS[[9, 10, 13, 32]] = True
    MARK = "\x01"

    def __init__(self, path: str):
        common.single_thread()
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.latin = regex.compile("[\\x21-\\x7eÀ-įı-ž]+").fullmatch
        spec["normalizer"], spec["added_tokens"] = None, []
        self.bare = Tokenizer.from_str(json.dumps(spec))
        (self.mark,) = self.bare.encode(self.MARK, add_special_tokens=False).ids
        self.memo = words.Memo(np.uint32, 1_000_000, 48 << 20)

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        strings = [c.decode() for c in new]
        plain = [bool(self.latin(c)) and not ("<|" in c and any(s in c for s in self.special)) for c in strings]
        easy = [c for c, p in zip(strings, plain, strict=True) if p]
        odd = [c for c, p in zip(strings, plain, strict=True) if not p]
        lines = ["".join(f"{c} {self.MARK} " for c in easy[i : i + 50]).lower() for i in range(0, len(easy), 50)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False))])
        cut = np.flatnonzero(ids == self.mark)
        if len(cut) != len(easy):
            raise RuntimeError("the mark between chunks was not kept")
        counts = np.diff(cut, prepend=-1) - 1
        ids = ids[ids != self.mark]
        if not odd:
            return ids, counts
        whole = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(odd, add_special_tokens=False)]
        parts, n = iter(np.split(ids, np.cumsum(counts)[:-1]) if easy else []), iter(whole)
        out = [next(parts) if p else next(n) for p in plain]
        return np.concatenate(out), np.array([len(x) for x in out])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given in UTF-8."""
        out: list[np.ndarray] = []
        for i, j in words.groups(texts):
            buf, text_at = words.joined(texts[i:j])
            first, last = words.spans(buf, self.BREAKS)
            ids, n = self.memo.values(buf, first, last, self._learn)
            ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, text_at)]
            out += [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    """One a Python worker: later tasks in it go on with what is remembered."""
    return common.held("token_codes", path, lambda: WordTokenizer(path))


# ---------------------------------------------------------------- Spark


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> list[dict]:
    """Encode ``docs`` into files in ascending id order; returns the files' directory, one entry a file.

    One range shuffle by id; each task encodes and writes its range.  The directory is the only
    thing that reaches the driver, an entry for each ``file_tokens`` tokens.
    """

    def run(batches):
        coder, context = word_tokenizer(tokenizer), TaskContext.get()
        end, number = np.array([end_id], np.uint32), 0
        doc_ids, counts, ids, tokens = [], [], [], 0

        def close():
            nonlocal number, tokens
            name = f"part-{context.partitionId():06d}-{number:06d}.dac"
            common.write_file(folder, name, file_parts(np.array(doc_ids), np.array(counts), np.concatenate(ids)), context.taskAttemptId())
            out = pa.RecordBatch.from_pydict({"part": [context.partitionId()], "number": [number], "file": [f"{folder}/{name}"], "docs": [len(counts)], "tokens": [tokens]})
            number, tokens = number + 1, 0
            for x in (doc_ids, counts, ids):
                x.clear()
            return out

        for b in common.slices(batches, 256):
            names = b.column(0).fill_null(NULL_ID).to_pylist()
            for doc, found in zip(names, coder.encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]), strict=True):
                small = found.astype(np.uint16) if len(found) == 0 or int(found.max()) < 65536 else found
                ids += [small, end.astype(small.dtype)]
                doc_ids.append(doc)
                counts.append(len(found) + 1)
                tokens += len(found) + 1
                if tokens >= file_tokens:
                    yield close()
        if counts:
            yield close()

    tag = F.xxhash64("text")
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id", tag)
        .sortWithinPartitions("id", tag, "text")
        .select("id", "text")
        .transform(common.arrow, run, "part long, number long, file string, docs long, tokens long")
        .collect()
    )
    found, start = [], 0
    for r in sorted(rows, key=lambda r: (r.part, r.number)):
        found.append({"file": r.file, "start": start, "docs": r.docs, "tokens": r.tokens})
        start += r.tokens
    return found


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = DacFile(uri)
                first = 0
                while first < f.docs:
                    # whole documents of together some million tokens
                    last = max(first + 1, int(np.searchsorted(f.doc_starts, f.doc_starts[first] + (1 << 20), "right")) - 1)
                    ids = f.tokens_between(int(f.doc_starts[first]), int(f.doc_starts[last]))
                    cut = f.doc_starts[first : last + 1] - f.doc_starts[first]
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * int(x) : 4 * int(y)]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    doc = f.doc_ids[first:last]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == NULL_ID), pa.array(f.doc_starts[first:last] + start), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    first = last

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    given = spark.createDataFrame([(f["file"], f["start"]) for f in files], "file string, start long")
    return given.repartition(len(files)).transform(common.arrow, run, schema)


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "tokens")
    files = write_token_files(common.table(spark, sf_dir, "documents"), scratch.path("dac"), common.tokenizer_file("word_bpe_49k.json"), 2)
    return read_token_files(spark, files)

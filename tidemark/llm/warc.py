"""WARC archives with a two-level capture index.

Archives: one gzip member a record.  Among records of equal payload of at least ``min_bytes`` the
one with the smallest page_id is a response; the others are revisits that carry no payload.

Index: capture lines under reversed-host keys ("com,example)/path"), range-partitioned and sorted;
each index file has gzip blocks of ``BLOCK`` lines and, at its end, a sparse directory with the
first key and place of each block.  The top level holds one first key an index file.  A lookup is a
binary search in the top level, one in the directory, one in a single block, and a range read of
the record.

Defined cases: null html is an empty payload; a null url has no target header and an empty key; a
record with null page_id is a response always; rows with equal page_id and payload are each of the
type that the id has; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 512
#: Record bytes (as stored) that a reading task takes, and that it reads in one stretch of a file.
TASK_BYTES, STRETCH = 64 << 20, 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id long, url string, digest string, record_type string, file string, offset long, length long"


def surt_key(url: str | None) -> str:
    """Reversed-host key; what is no url with a host stays as it is, escaped."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        host = ""
    if not host:
        return quote(url, safe="/:?#[]@!$&'()*+,;=%")
    host = host.removeprefix("www.") or host
    key = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        key += f":{port}"
    return quote(key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe="/:?#[]@!$&'()*+,;=%")


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}').urn}>"
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(f"{page_id}:{url}")), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if page_id is not None:
        head.append(("WARC-X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-X-Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """(headers, length of the full payload, stored payload) of a record; its digest is checked where the payload is stored."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")
    full = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if head["WARC-Type"] == "response" and (len(payload) != full or "sha1:" + base32_sha1(payload) != head["WARC-Payload-Digest"]):
        raise ValueError("a payload does not agree with its header")
    return head, full, payload


# ---------------------------------------------------------------- writing


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id and refers_to of the records that revisit another: counts by digest first, no payload moves.

    The first of each digest is a written table, so that the join may split a payload that very many pages have.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    first = keys.groupBy("sha", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = common.Scratch(pages.sparkSession, "revisits").keep(first, "first")
    return keys.join(first, ["sha", "n"]).where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write one archive a task; a lazy table of capture entries (the caller keeps it, so that it runs once)."""

    def run(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        fs, base = common.filesystem(folder)
        temp, at, out = f"{base}/.{name}.{context.taskAttemptId()}", 0, None
        for b in common.slices(batches):
            rows = {k: [] for k in ("key", "page_id", "url", "digest", "record_type", "file", "offset", "length")}
            for page, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(temp)
                payload = (html or "").encode()
                digest = base32_sha1(payload)
                raw = gz(record(page, url, payload, digest, refers))
                out.write(raw)
                for k, v in zip(rows, (surt_key(url), page, url, digest, "response" if refers is None else "revisit", f"{folder}/{name}", at, len(raw)), strict=True):
                    rows[k].append(v)
                at += len(raw)
            if rows["key"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("page_id", "offset", "length") else pa.string()) for k, v in rows.items()], list(rows))
        if out is not None:
            out.close()
            fs.move(temp, f"{base}/{name}")

    html = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("sha"))
    given = given.join(revisits(pages, min_bytes), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")
    # ordered, so that a task that runs again writes the same bytes
    return given.sortWithinPartitions("page_id", "url", "html").transform(common.arrow, run, ENTRY)


def write_index(entries: DataFrame, folder: str) -> list[dict]:
    """Sorted, blocked capture lines; returns the top level, one row an index file."""

    def run(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.cdxb"
        parts, directory, at, lines = [], [], 0, []
        count = size = 0

        def close():
            nonlocal at
            raw = gz("".join(lines).encode())
            directory.append([lines[0].split(" ", 1)[0], at, len(raw)])
            parts.append(raw)
            at += len(raw)
            lines.clear()

        for b in batches:
            for row in b.to_pylist():
                lines.append(f"{row.pop('key')} {json.dumps(row)}\n")
                count += 1
                size += row["length"]
                if len(lines) == BLOCK:
                    close()
        if lines:
            close()
        if not count:
            return
        tail = gz(json.dumps(directory).encode())
        common.write_file(folder, name, [*parts, tail, struct.pack("<QI", at, len(tail))], context.taskAttemptId())
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [f"{folder}/{name}"], "first_key": [directory[0][0]], "entries": [count], "bytes": [size]})

    rows = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset").transform(common.arrow, run, "part long, file string, first_key string, entries long, bytes long").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r.part)]


# ---------------------------------------------------------------- reading


class IndexFile:
    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, n = struct.unpack("<QI", self.file.read_at(12, size - 12))
        self.directory = json.loads(gunzip(self.file.read_at(n, at)))
        self.keys = [d[0] for d in self.directory]

    def block(self, k: int) -> list[tuple[str, dict]]:
        _, at, n = self.directory[k]
        return [(key, json.loads(rest)) for key, rest in (line.split(" ", 1) for line in gunzip(self.file.read_at(n, at)).decode().splitlines())]


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], int, bytes]:
    fs, path = common.filesystem(uri)
    with fs.open_input_file(path) as f:
        return parse(gunzip(f.read_at(length, offset)))


def lookup(top: list[dict], url: str) -> list[dict]:
    """All captures of a url, by two binary searches and single blocks; equal keys may span blocks and files."""
    key, found = surt_key(url), []
    i = max(0, bisect.bisect_left([t["first_key"] for t in top], key) - 1)
    for t in top[i:]:
        if t["first_key"] > key:
            break
        f = IndexFile(t["file"])
        for k in range(max(0, bisect.bisect_left(f.keys, key) - 1), len(f.keys)):
            if f.keys[k] > key:
                return found
            lines = f.block(k)
            keys = [x[0] for x in lines]
            found += [x[1] for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
    return found


def read_archives(spark: SparkSession, top: list[dict]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every capture, through the index.

    Tasks follow the bytes of the records, not those of their places: stretches of ``STRETCH`` bytes of a file
    are dealt to a task for every ``TASK_BYTES``, one a core at least.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def entries(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                f = IndexFile(uri)
                for k in range(len(f.directory)):
                    rows = [x[1] for x in f.block(k)]
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"] for r in rows]), *(pa.array([r[c] for r in rows], pa.int64()) for c in ("offset", "length"))], ["file", "offset", "length"])

    def records(batches):
        name, f = None, None
        for b in batches:
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
            for uri, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if uri != name:
                    fs, path = common.filesystem(uri)
                    name, f = uri, fs.open_input_file(path)
                head, full, _ = parse(gunzip(f.read_at(length, offset)))
                number = lambda h, head=head: int(head[h]) if h in head else None
                for k, v in zip(out, (number("WARC-X-Page-ID"), full, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number("WARC-X-Refers-To-Page-ID"), head.get("WARC-Target-URI")), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("page_id", "payload_bytes", "refers_to") else pa.string()) for k, v in out.items()], list(out))

    if not top:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(t["file"],) for t in top], "file string").repartition(len(top))
    places = files.transform(common.arrow, entries, "file string, offset long, length long")
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(t["bytes"] for t in top) // TASK_BYTES))
    return places.repartition(tasks, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset").transform(common.arrow, records, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "warc")
    entries = scratch.keep(write_archives(common.table(spark, sf_dir, "pages"), scratch.path("warc")), "entries")
    return read_archives(spark, write_index(entries, scratch.path("index"))).drop("url")


_BITS = ", ".join(f"'{k:04b}'" for k in range(16))
_FIVE = " + ".join(f"{16 >> j} * CAST(substr(bits, 5 * k + {j + 1}, 1) AS INTEGER)" for j in range(5))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: list_extract([{_BITS}], strpos('0123456789abcdef', substr(h, i, 1)))), '') AS bits FROM p),
f AS (SELECT h, payload_bytes, min(page_id) AS least FROM p GROUP BY 1, 2)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM b JOIN f USING (h, payload_bytes)
"""

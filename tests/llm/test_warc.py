import base64
import hashlib

from pyspark.sql import functions as F
from tidemark.llm import common, warc

PAGES = [
    (1, "http://www.b.example.com:80/x?q=1", "<p>é</p>"), (2, "https://a.example.com:8443/", "<p>é</p>"), (3, None, None), (4, "not a url\n", ""), (5, "http://b.example.com/x", "z" * 100_000),
    (2, "https://a.example.com:8443/", "<p>é</p>"), (None, "http://c.example.com/", "<p>é</p>"), (6, "http://b.example.com/x", "other"), (7, "http://[bad", "<p>é</p>"),
]


def test_keys():
    assert warc.surt_key("http://www.B.example.com:80/x?q=1") == "com,example,b)/x?q=1"
    assert warc.surt_key("https://a.example.com:8443") == "com,example,a:8443)/"
    assert warc.surt_key(None) == "" and " " not in warc.surt_key("a b")


def test_round_trip_and_lookup(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, sha string, refers_to string").repartition(3)
    scratch = common.Scratch(spark, "w")
    entries = scratch.keep(warc.write_archives(pages, scratch.path("warc")), "entries")
    top = warc.write_index(entries, scratch.path("index"))
    rows = [tuple(r)[:5] for r in warc.read_archives(spark, top).collect()]
    expected = []
    for page, _, html in PAGES:
        h = (html or "").encode()
        first = min(p for p, _, x in PAGES if (x or "").encode() == h and p is not None)
        revisit = page is not None and page > first
        expected.append((page, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: (r[0] or -1, r[2])
    assert sorted(rows, key=key) == sorted(expected, key=key)
    found = warc.lookup(top, "http://b.example.com/x")
    assert sorted(f["page_id"] for f in found) == [5, 6]
    big = next(f for f in found if f["page_id"] == 5)
    assert warc.read_record(big["file"], big["offset"], big["length"])[2] == b"z" * 100_000
    assert warc.lookup(top, "http://nowhere.example.org/") == []
    none = scratch.keep(warc.write_archives(pages.where("false"), scratch.path("warc0")), "entries0")
    assert warc.read_archives(spark, warc.write_index(none, scratch.path("index0"))).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "ab"), (2, "http://b.example/", "ab")], "page_id long, url string, html string")
    assert warc.revisits(pages, 3).count() == 0 and warc.revisits(pages, 2).count() == 1


def test_many_blocks(spark, monkeypatch):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 7, '.example.com/same') AS url", "cast(id AS string) AS html")
    scratch = common.Scratch(spark, "w")
    entries = scratch.keep(warc.write_archives(pages, scratch.path("warc")), "entries")
    top = warc.write_index(entries, scratch.path("index"))
    assert sorted(f["page_id"] for f in warc.lookup(top, "http://h3.example.com/same")) == list(range(3, 3000, 7))


def test_reading_tasks_follow_the_bytes(spark, tmp_path, monkeypatch):
    """Two archives, one far larger: its stretches go to many tasks, and every record is read once."""
    pages = spark.createDataFrame([(k, f"http://h/{k}", ("%d " % k) * 3000) for k in range(400)], "page_id long, url string, html string").coalesce(1)
    top = warc.write_index(warc.write_archives(pages, str(tmp_path / "w")).persist(), str(tmp_path / "i"))
    assert sum(t["entries"] for t in top) == 400 and sum(t["bytes"] for t in top) == sum(f.stat().st_size for f in (tmp_path / "w").iterdir() if f.name.endswith(".gz"))
    monkeypatch.setattr(warc, "STRETCH", 1 << 10)
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 12)
    few = warc.read_archives(spark, top)
    assert few.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-sum(t["bytes"] for t in top) // (1 << 12))) > 4
    held = [n for n in few.groupBy(F.spark_partition_id()).count().toPandas()["count"] if n]
    assert sum(held) == 400 and len(held) > 4 and sorted(r.page_id for r in few.collect()) == list(range(400))

"""Archives and index: round trip, lookups, edge rows."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tidebars.llm import warc
from tidebars.session import shared_folder

SCHEMA = "page_id long, url string, html string, key string, file int, refers_to string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, None) for r in rows], SCHEMA).repartition(3)


def edge_pages():
    same = "<html>same</html>"
    return [
        (1, "http://www.Example.com:80/a?b#c", same), (2, "https://user@example.com/a", same), (3, None, None), (4, "", ""), (5, "http://example.com", same),
        (5, "http://example.com", same), (6, "example.org/x y\tz", "é" * 50_000), (None, "http://n.example.com/", same), (None, None, None), (7, "http://é.example/ü", "x"), (-8, "ftp://a.b.c/d", "y"),
    ]


def expected(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last.get(h or "") if i is not None else None
        again = to is not None and to != i and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:4])


def test_edge_rows(spark):
    for least in (0, 10):
        out = warc.round_trip(pages(spark, edge_pages()), least_bytes=least).collect()
        assert sorted(map(tuple, out), key=key) == sorted(expected(edge_pages(), least), key=key)


def test_index_blocks(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 50}", f"text {i}") for i in range(500)]
    root = shared_folder(spark, "warc")
    captures = warc.write_archives(pages(spark, rows), root)
    shards = warc.write_index(captures, f"{root}-index", block=13)
    index = warc.Index(f"{root}-index", shards)
    places = {r.key: (r.file, r.offset, r.length) for r in captures.collect()}
    assert len(places) == 500
    for k in sorted(places):
        assert index.find(k.encode()) == [places[k]]
    assert index.find(b"zzz") == [] and index.find(b"") == []
    file, offset, length = places[sorted(places)[3]]
    with open(f"{root}/{file}", "rb") as f:
        f.seek(offset)
        assert gzip.decompress(f.read(length)).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_surt(spark):
    df = spark.createDataFrame([("https://WWW.Example.com:8080/a/b?c=d#e",), ("x.org",), (None,)], "u string")
    assert [r[0] for r in df.select(warc.surt(F.col("u"))).collect()] == ["com,example,www)/a/b?c=d", "org,x)/", ")/"]


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0

"""WARC archives with a two-level capture index.

Writing: a page is a ``response`` record, or a ``revisit`` when a page with a larger id has the same payload. Records are
gzip members, one archive per task. Index: entries are sorted by key (reversed host, path, page id) into shards; a shard is
a row of compressed blocks of ``BLOCK`` entries with a sparse directory (first key, offset and length of each block).
Reading: keys are looked up in sorted order - binary search over shards, over the directory, in the block - and the
captures found are read by range, archive by archive, in order of offset.

Null html is the empty payload; null url has the empty host; a null page id sorts first, is never referred to and refers
to no other. Rows that repeat a page id and its payload are both responses. Payloads under ``least_bytes`` are always
responses. Only shard names and first keys (one per index file) reach the driver. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidebars.llm.shared import make_folder, open_input, open_output, rename
from tidebars.session import fan_out, materialize, shared_folder

BLOCK = 3_000
#: A page table has no capture time, so records carry a fixed one.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: Column) -> Column:
    """Sort-friendly form of a URL: ``com,example,www)/path?query``; scheme, user, port and fragment are dropped."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*", 0), r"^.*@|:\d*$", ""))
    path = F.regexp_replace(plain, r"^[^/?]*/?", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")/"), path)
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def capture_key(url: Column, page_id: Column) -> Column:
    return F.concat_ws(" ", surt(url), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``sha1``, ``refers_to`` of every page; payloads are shuffled once, by id."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    small = rows.select("page_id", "sha1", F.octet_length("payload").alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= least_bytes))
    last = small.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = small.join(last, "sha1").where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()
    return rows.join(later, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and HTTP body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages; returns the captures: ``key``, ``file``, ``offset``, ``length``."""
    make_folder(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        hidden, out, at = f"{folder}/_{name}-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            if out is None:
                out = open_output(hidden)
            offsets, lengths = [], []
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.record_batch([batch.column(5), pa.array([name] * batch.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()
            rename(hidden, f"{folder}/{name}")

    rows = planned(pages, id_col, url_col, html_col, least_bytes).withColumn("key", capture_key(F.col("url"), F.col("page_id")))
    return materialize(rows.mapInArrow(run, "key string, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> list[tuple[bytes, str]]:
    """Sort captures into shards of compressed blocks; returns (first key, shard) in order of keys."""
    make_folder(captures.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{TaskContext.get().partitionId():06d}"
        hidden, out, at, lines, directory = f"{folder}/_{name}-{uuid.uuid4().hex}", None, 0, [], []

        def close_block() -> None:
            nonlocal at, lines
            packed = zlib.compress(b"\n".join(lines))
            out.write(packed)
            directory.append(b"%s\t%d\t%d" % (lines[0].split(b"\t", 1)[0], at, len(packed)))
            at, lines = at + len(packed), []

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if out is None:
                    out = open_output(hidden)
                lines.append(f"{key}\t{file}\t{offset}\t{length}".encode())
                if len(lines) >= block:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            rename(hidden, f"{folder}/{name}.blocks")
            with open_output(f"{hidden}-dir") as f:
                f.write(b"\n".join(directory))
            rename(f"{hidden}-dir", f"{folder}/{name}.directory")
            yield pa.record_batch([pa.array([directory[0].split(b"\t")[0]]), pa.array([name])], ["key", "shard"])

    dealt = captures.repartitionByRange("key").sortWithinPartitions("key")
    return sorted((bytes(r["key"]), r["shard"]) for r in dealt.mapInArrow(run, "key binary, shard string").collect())  # one row per index file


class Index:
    """Lookups in order of keys; the directory of one shard and one block are held."""

    def __init__(self, folder: str, shards: list[tuple[bytes, str]]):
        self.folder, self.shards, self.firsts = folder, shards, [k for k, _ in shards]
        self.shard, self.block = None, None

    def _open(self, shard: str) -> None:
        with open_input(f"{self.folder}/{shard}.directory") as f:
            rows = [line.split(b"\t") for line in f.read().split(b"\n")]
        self.places = [(int(a), int(n)) for _, a, n in rows]
        self.starts, self.shard, self.block = [r[0] for r in rows], shard, None

    def _read(self, block: int) -> None:
        at, n = self.places[block]
        with open_input(f"{self.folder}/{self.shard}.blocks") as f:
            f.seek(at)
            self.lines = [line.split(b"\t") for line in zlib.decompress(f.read(n)).split(b"\n")]
        self.keys, self.block = [x[0] for x in self.lines], block

    def find(self, key: bytes) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures with this key."""
        s = bisect_right(self.firsts, key) - 1
        if s < 0:
            return []
        if self.shards[s][1] != self.shard:
            self._open(self.shards[s][1])
        found = []
        for b in range(max(0, bisect_left(self.starts, key) - 1), bisect_right(self.starts, key)):  # equal keys may go on in the next block
            if b != self.block:
                self._read(b)
            found += [(x[1].decode(), int(x[2]), int(x[3])) for x in self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]]
        return found


def look_up(keys: DataFrame, folder: str, shards: list[tuple[bytes, str]]) -> DataFrame:
    """Captures (``file``, ``offset``, ``length``) of the distinct values of ``keys.key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards)
        for batch in batches:
            found = [x for key in batch.column(0).to_pylist() for x in index.find(key.encode())]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.record_batch([pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.int64())], ["file", "offset", "length"])

    asked = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return asked.mapInArrow(run, "file string, offset long, length long")


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """``page_id``, ``record_type``, ``payload`` (empty for revisits), ``stated`` (digest in the header), ``refers_to``."""

    def page(value: str | None) -> int | None:
        digits = value[len("<urn:page:") : -1] if value else ""
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if file != name:
                    if archive is not None:
                        archive.close()
                    name, archive = file, open_input(f"{folder}/{file}")
                archive.seek(offset)
                fields, payload = parse(zlib.decompress(archive.read(length), 31))
                out.append((page(fields["warc-record-id"]), fields["warc-type"], payload, fields["warc-payload-digest"].removeprefix("sha1:"), page(fields.get("warc-refers-to"))))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "record_type", "payload", "stated", "refers_to"])

    # An explicit number: captures are small rows that stand for large reads, so partitions must not be merged by size.
    ordered = captures.repartition(fan_out(captures.sparkSession), "file").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return ordered.mapInArrow(run, "page_id long, record_type string, payload binary, stated string, refers_to long")


def digested(records: DataFrame) -> DataFrame:
    """Payload size and digest of every record: a response's own, a revisit's from the response it refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(2).to_pylist()
            digest = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array(digest, pa.string()), batch.column(3), batch.column(4)],
                ["page_id", "record_type", "payload_bytes", "payload_digest", "stated", "refers_to"],
            )

    kinds = "page_id long, record_type string, payload_bytes long, payload_digest string, stated string, refers_to long"
    rows = materialize(records.mapInArrow(run, kinds), "records")
    answer = rows.where("record_type = 'response'").select(
        F.col("page_id").alias("to_id"), F.col("payload_digest").alias("stated"), F.col("payload_bytes").alias("to_bytes")
    ).distinct()
    again = rows.where("record_type = 'revisit'").join(answer.withColumnRenamed("to_id", "refers_to"), ["refers_to", "stated"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*columns).union(
        again.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.when(F.col("to_bytes").isNotNull(), F.col("stated")).alias("payload_digest"), "record_type", "refers_to")
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives and index to fresh shared folders, look every page up, read it back."""
    root = shared_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, root, id_col, url_col, html_col, least_bytes)
    shards = write_index(captures, f"{root}-index")
    keys = pages.select(capture_key(F.col(f"`{url_col}`"), F.col(f"`{id_col}`").cast("long")).alias("key"))
    return digested(read_captures(look_up(keys, f"{root}-index", shards), root))

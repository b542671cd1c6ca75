"""WARC archives with a two-level capture index.

Each task writes its pages to one archive, a gzip member per record. Of the pages with equal
payloads that with the smallest id is a response; the others are revisit records, which
carry the HTTP header and refer to it. The captures' keys, URLs with the host's
labels reversed, are sorted over all archives and written in compressed blocks of LINES lines; the
end of each index file holds a sparse directory with the first key of each block, and a
manifest the first key of each file. A reader finds the file, then the block, by binary
search, range-reads the block, and then range-reads the record.

Results: a null payload is empty; a null URL is written as an empty one; a null id is no smallest
id unless all are null, and then all are responses; repeated rows with the smallest
id are all responses. Other columns are dropped. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import store
from sparkloom.llm.files import Reader, Writer

LINES = 1000
DATE = "2000-01-01T00:00:00Z"
NO_ID = -(1 << 63)
CAPTURES = "key string, page_id long, uri string, at long, size long"
INDEX = "key string, page_id long, uri string, blocks long"


def reversed_host(url: str | None) -> str:
    """com,example,www)/path?query of a URL; scheme, port, user and fragment do not count.

    The host of a numeric IPv6 address stays as it is, in its brackets; a URL that cannot be parsed is its own key.
    """
    text = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    try:
        parts = urlsplit(text)
    except ValueError:
        return text
    place = parts.netloc.rpartition("@")[2].lower()
    if place.startswith("["):
        return place.partition("]")[0] + "])" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    host = place.partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    digest = digest_of(payload)
    name = lambda i: f"<urn:x-page:{'none' if i is None else i}:{digest}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", "WARC-Target-URI: " + quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """Fields of a record, checked against its digests."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    of = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(of["Content-Length"])]
    if f"sha1:{digest_of(block)}" != of["WARC-Block-Digest"]:
        raise ValueError("the block is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = of["WARC-Payload-Digest"].removeprefix("sha1:")
    if of["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("the payload is damaged")
    number = lambda x: None if x.split(":")[2] == "none" else int(x.split(":")[2])
    return {"page_id": number(of["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": of["WARC-Type"], "refers_to": number(of["WARC-Refers-To"]) if "WARC-Refers-To" in of else None, "payload": payload if of["WARC-Type"] == "response" else None}


def write(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives; (key, page_id, uri, at, size) of their records.

    Payloads of fewer than least bytes are always responses.
    """
    spark = df.sparkSession
    folder = folder or store.scratch(spark, "warc")
    src = df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("digest", F.unhex(F.sha1("payload")))
    groups = src.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    marked = src.join(groups, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        with Writer(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz") as out:
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:x-file:{out.uri.rpartition('/')[2]}>\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            out.write(gzip.compress(info.encode(), 6, mtime=0))
            found = []
            while first is not None:
                for start in range(0, len(first), 256):
                    for r in first.slice(start, 256).to_pylist():
                        revisit = r["first"] is not None and r["page_id"] != r["first"]
                        member = record(r["page_id"], r["url"], r["payload"], r["first"], revisit)
                        found.append((reversed_host(r["url"]), NO_ID if r["page_id"] is None else r["page_id"], out.write(member), len(member)))
                first = next(batches, None)
        cols = list(zip(*found, strict=True))
        for k in range(0, len(found), 65536):
            s = slice(k, k + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][s], pa.string()), pa.array(cols[1][s], pa.int64()), pa.array([out.uri] * len(cols[0][s]), pa.string()), pa.array(cols[2][s], pa.int64()), pa.array(cols[3][s], pa.int64())], names=["key", "page_id", "uri", "at", "size"])

    return store.table(marked.select("page_id", "url", "payload", "first").mapInArrow(run, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str | None = None, lines: int = LINES) -> DataFrame:
    """Write the sorted index; (key, page_id, uri, blocks) with the first capture of each file."""
    spark = captures.sparkSession
    folder = folder or store.scratch(spark, "capture-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        held: list[list] = []
        directory: list[list] = []
        with Writer(folder, f"part-{TaskContext.get().partitionId():06d}.cdx.gz") as out:

            def flush() -> None:
                packed = gzip.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode(), 6, mtime=0)
                directory.append([held[0][0], held[0][1], out.write(packed), len(packed)])
                held.clear()

            while first is not None:
                for r in zip(*(first.column(c).to_pylist() for c in ("key", "page_id", "uri", "at", "size")), strict=True):
                    held.append(list(r))
                    if len(held) == lines:
                        flush()
                first = next(batches, None)
            if held:
                flush()
            packed = gzip.compress(json.dumps(directory, ensure_ascii=False).encode(), 6, mtime=0)
            out.write(packed + struct.pack("<Q", len(packed)))
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([out.uri]), pa.array([len(directory)], pa.int64())], names=["key", "page_id", "uri", "blocks"])

    parts = store.files_for(captures, F.octet_length("key") + 100)
    return store.table(captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, INDEX), "index-files")


class Index:
    """Captures by key; files, then blocks, are found by binary search."""

    def __init__(self, files: list[tuple[str, int, str]]) -> None:
        # code-point order, as the sorted UTF-8 bytes
        self.files = sorted(files)
        self.now = self.block = (None, None)

    def _file(self, k: int) -> tuple[Reader, list]:
        if self.now[0] != k:
            if self.now[0] is not None:
                self.now[1][0].close()
            r = Reader(self.files[k][2])
            n = struct.unpack("<Q", r.read(r.size - 8, 8))[0]
            self.now = k, (r, json.loads(gzip.decompress(r.read(r.size - 8 - n, n))))
            self.block = (None, None)
        return self.now[1]

    def _lines(self, k: int, b: int) -> list:
        reader, directory = self._file(k)
        if self.block[0] != (k, b):
            _, _, at, size = directory[b]
            self.block = (k, b), [json.loads(x) for x in gzip.decompress(reader.read(at, size)).decode().split("\n")]
        return self.block[1]

    def find(self, key: str, page_id: int | None = None) -> Iterator[list]:
        """[key, page_id, uri, at, size] of the captures of a key, or of one page of it."""
        low = (key, NO_ID if page_id is None else page_id)
        # a file or block before the last that begins at or before low can end with equal captures only if it begins with one
        k = max(0, self._left(self.files, low))
        while k < len(self.files) and tuple(self.files[k][:2]) <= (low if page_id is not None else (key, 1 << 63)):
            directory = self._file(k)[1]
            b = max(0, self._left(directory, low))
            while b < len(directory) and tuple(directory[b][:2]) <= (low if page_id is not None else (key, 1 << 63)):
                for x in self._lines(k, b):
                    if x[0] == key and (page_id is None or x[1] == page_id):
                        yield x
                b += 1
                directory = self._file(k)[1]
            k += 1

    @staticmethod
    def _left(entries: list, low: tuple[str, int]) -> int:
        """The last entry that begins before low, as equal captures may end what it begins."""
        return bisect_left(entries, low, key=lambda e: (e[0], e[1])) - 1


def lookup(queries: DataFrame, index: DataFrame, url: str = "url", page_id: str | None = None) -> DataFrame:
    """Records of the captures of the queries' URLs (and ids), without the payload's text.

    Queries are sorted as the index is, so a task goes through its blocks once. The index manifest, a row
    per file, is collected; the directories stay in the files.
    """
    files = [(r.key, r.page_id, r.uri) for r in index.select("key", "page_id", "uri").collect()]
    spark = queries.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reversed_host(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")], names=["key", "page_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(files)
        archives: dict[str, Reader] = {}
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            rows = []
            for key, p in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                for _, _, uri, at, size in found.find(key, p):
                    if uri not in archives:
                        if len(archives) >= 64:
                            archives.pop(next(iter(archives))).close()
                        archives[uri] = Reader(uri)
                    rows.append(parse(archives[uri].read(at, size)))
                    rows[-1].pop("payload")
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ids = F.coalesce(F.col(f"`{page_id}`").cast("long"), F.lit(NO_ID)) if page_id else F.lit(None).cast("long")
    asked = queries.select(F.col(f"`{url}`").cast("string").alias("url"), ids.alias("page_id")).mapInArrow(keyed, "key string, page_id long").distinct()
    asked = store.table(asked, "asked")
    return asked.repartitionByRange(store.files_for(asked, F.octet_length("key") + 8), "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = build_index(write(pages))
    return lookup(pages, index, page_id="page_id")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, html, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""

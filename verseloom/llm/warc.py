"""WARC archives with a two-level capture index (operator 2).

Pages become WARC 1.1 records, each its own gzip member, in files of the shared folder. Of records with
equal payloads (of at least ``least`` bytes) the one with the smallest page_id is a response, the others
are revisits that refer to it and carry no payload.

The index: lines (reversed-host key, page, file, offset, length) are sorted by range; each range is one
index file of zlib blocks of BLOCK_LINES lines, and a directory of the blocks' first keys at its end.
The top level lists the index files' first keys, one a range. A look-up searches the top level, the
directory and one block by bisection, and then range-reads one record.

Files are opened by the shared folder's URI; a task writes under a new name, and names only get into the
index with the rows that the task returned, so lost executors and retries leave no half records in it.

Null html counts as an empty payload, null and odd urls are keys of their own, null ids count as larger
than any. Rows that repeat an id and a payload are all responses or all revisits alike. Long pages are
written whole. An empty table gives an empty result. Only the three columns named are read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseloom.llm.shared import fresh_path, map_arrow, materialize, rows, shuffle_partitions

BLOCK_LINES = 512
#: Bytes after which a task begins another archive file.
FILE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: str | None) -> str:
    """``com,example,www)/path?query``: hosts of a domain, and pages of a host, are neighbours."""
    try:
        parts = urllib.parse.urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return f"invalid){url}"
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _header(value: str) -> str:
    """A header value without line breaks or other controls."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@functools.lru_cache(maxsize=16)
def _opened(uri: str) -> pa.NativeFile:
    system, path = _filesystem(uri)
    return system.open_input_file(path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    file = _opened(uri)
    file.seek(offset)
    return file.read(length)


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, sha1, first) of pages whose payload a page with a smaller id has too."""
    digests = materialize(pages.select("page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha1"), F.octet_length("html").alias("n")).where(F.col("n") >= least), "payloads")
    firsts = materialize(digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha1", "first"), "first-payloads")
    return digests.join(firsts, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first"))).groupBy("page_id", "sha1").agg(F.min("first").alias("first"))


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the records and returns their index lines (key, page_id, file, offset, length)."""
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = revisits(source, least).select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("__id"), "sha1", "first")
    keyed = source.withColumn("__id", F.coalesce("page_id", F.lit(-(1 << 63)))).withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    decided = keyed.join(again, ["__id", "sha1"], "left").select("page_id", "url", "html", "sha1", "first")
    folder = fresh_path(spark, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        out, name, at = None, "", 0
        try:
            for ids, urls, htmls, sha1s, firsts in rows(batches, 256):
                cols: list[list] = [[] for _ in range(5)]
                for page, url, html, sha1, first in zip(ids, urls, htmls, sha1s, firsts):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        system.create_dir(root, recursive=True)
                        file, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        name, out = f"{folder}/{file}", system.open_output_stream(f"{root}/{file}", compression=None)
                    data = record(page, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(sha1).decode(), first, first is not None)
                    out.write(data)
                    for col, v in zip(cols, (capture_key(url), page, name, at, len(data))):
                        col.append(v)
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialize(map_arrow(decided, run, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(lines: DataFrame) -> list[tuple[str, int, str, int, int]]:
    """Writes the index files; the top level: (first key, first page, file, directory's offset, length), one a range."""
    folder = fresh_path(lines.sparkSession, "capture-index")
    ranged = lines.withColumn("page", F.coalesce("page_id", F.lit(-(1 << 63)))).select("key", "page", "file", "offset", "length")
    ranged = ranged.repartitionByRange(shuffle_partitions(lines.sparkSession), "key", "page").sortWithinPartitions("key", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        held: list[list] = []
        directory: list[list] = []
        out, file, at = None, "", 0

        def flush() -> None:
            nonlocal out, file, at
            if out is None:
                system.create_dir(root, recursive=True)
                file = f"index-{uuid.uuid4().hex}"
                out = system.open_output_stream(f"{root}/{file}", compression=None)
            block = zlib.compress(json.dumps(held).encode("utf-8", "surrogatepass"), 1)
            directory.append([*held[0][:2], at, len(block)])
            out.write(block)
            at += len(block)
            held.clear()

        for cols in rows(batches, BLOCK_LINES):
            for line in zip(*cols):
                held.append(list(line))
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode("utf-8", "surrogatepass"), 1)
            out.write(data)
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([f"{folder}/{file}"]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], ["key", "page", "file", "offset", "length"])

    top = materialize(map_arrow(ranged, run, "key string, page long, file string, offset long, length long"), "index-top")
    return sorted(tuple(r) for r in top.collect())  # a row a range of the index


class CaptureIndex:
    """Look-ups by the top level, a directory and a block, each by bisection; the last directory and block are kept."""

    def __init__(self, top: list[tuple[str, int, str, int, int]]) -> None:
        self.top = top
        self.firsts = [t[:2] for t in top]
        self.directory: tuple[int, list[tuple], list[list]] = (-1, [], [])
        self.block: tuple[tuple, list[tuple], list[list]] = ((), [], [])

    def range_of(self, key: str, page: int) -> int:
        return bisect.bisect_right(self.firsts, (key, page)) - 1

    def find(self, key: str, page: int) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the records of a key and page."""
        k = self.range_of(key, page)
        if k < 0:
            return
        _, _, file, offset, length = self.top[k]
        if self.directory[0] != k:
            entries = json.loads(zlib.decompress(read_range(file, offset, length)))
            self.directory = (k, [tuple(e[:2]) for e in entries], entries)
        at = max(0, bisect.bisect_left(self.directory[1], (key, page)) - 1)
        while at < len(self.directory[1]) and self.directory[1][at] <= (key, page):
            if self.block[0] != (k, at):
                lines = json.loads(zlib.decompress(read_range(file, *self.directory[2][at][2:])))
                self.block = ((k, at), [tuple(x[:2]) for x in lines], lines)
            _, keys, lines = self.block
            for x in range(bisect.bisect_left(keys, (key, page)), bisect.bisect_right(keys, (key, page))):
                yield tuple(lines[x][2:])
            at += 1


def read_back(spark: SparkSession, queries: DataFrame, top: list[tuple[str, int, str, int, int]]) -> DataFrame:
    """One row a query (key, page_id), from the record that the index leads to; repeats of a query get a record each."""
    wanted = queries.withColumn("page", F.coalesce("page_id", F.lit(-(1 << 63)))).groupBy("key", "page").count().select("key", "page")
    dealt = wanted.repartitionByRange(shuffle_partitions(spark), "key", "page").sortWithinPartitions("key", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(top)
        for keys, pages in rows(batches, 256):
            cols: list[list] = [[] for _ in range(6)]
            for key, page in zip(keys, pages):
                for file, offset, length in index.find(key, page):
                    fields, http, payload = parse(read_range(file, offset, length))
                    ident = fields["WARC-Record-ID"][10:-1]
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"record of page {ident} in {file} is damaged")
                    refers = int(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
                    for col, v in zip(cols, (None if ident == "None" else int(ident), size, digest, kind, refers, fields["WARC-Target-URI"])):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    return map_arrow(dealt, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages, indexes them and reads every one back through the index."""
    lines = write_archives(pages, least)
    return read_back(pages.sparkSession, lines.select("key", "page_id"), write_index(lines))

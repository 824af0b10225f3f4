"""WARC writing and a splittable reader.

Writer: one gzip member per record. Of pages with equal payloads the one with the largest page_id is written as a response, the others
as revisits that refer to it. Tasks write archives of bounded size into the shared folder under names of their own and report
(path, length); only reported files are read, so files of lost attempts do no harm.

Reader: files are cut into byte ranges. A task looks for gzip magic in its range, decodes the header (of any length) of each candidate member, and
takes it as a record only if it begins with a WARC version line, parses and decodes whole to the stated length. The first one of a range must also be
followed by ``CHAIN`` such members or the end of the file, so that members inside a record are not mistaken for records; from there each record ends where the next
begins, and the start of a file needs no such proof. A task owns the records that start inside its range and reads past the end of it to finish the last one.
Archives of others are read too: records of every type, page_id null where none is stated. A member is decoded no further than its header says.
A record of a damaged file is lost only if it is the first of its range and fewer than ``CHAIN`` records stand between it and the damage.

Files go through Spark's shared folder by ``pyarrow.fs``, which opens local, HDFS and object store addresses alike.

Nulls: a null html is an empty payload; a null url is written empty; a null page_id is written as ``null``, sorts lowest and comes back null.
Rows that repeat the largest page_id of their payload are all responses. An empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import scratch, table, written

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
BLOCK = 1 << 20
#: Members that must follow the first one found in a range.
CHAIN = 4
VERSION = re.compile(rb"WARC/1\.\d\r\n")
VERSION_BYTES = len("WARC/1.1\r\n")
#: Compressed bytes of a read while a header is looked for.
HEADER_READ = 1 << 14


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(kind: str, page: str, url: str, digest: str, n_bytes: int, payload: bytes, refers: str) -> bytes:
    """One record, not compressed. The HTTP head states the length of the full payload, for revisits too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http + payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers} {digest}')}>", f"X-Refers-To-Page-ID: {refers}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Lazy (path, length, records) of the archives of pages(page_id, url, html)."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html"))
    largest = p.groupBy("sha").agg(F.max("page_id").alias("largest"))
    p = p.join(largest, "sha").withColumn("response", F.col("page_id").eqNullSafe(F.col("largest")))
    p = p.withColumn("html", F.when(F.col("response"), F.col("html")))  # revisits carry no payload from here on

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out = done = None
        n = size = 0
        for b in batches:
            for page, url, html, sha, n_bytes, largest, response in zip(b.page_id, b.url, b.html, b.sha, b.n_bytes, b.largest, b.response, strict=True):
                if out is None:
                    done = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{root}/{done}", compression=None), 0, 0
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                page, largest = ("null" if pd.isna(x) else str(int(x)) for x in (page, largest))
                kind = "response" if response else "revisit"
                data = member(record(kind, page, url, digest, int(n_bytes), html.encode() if response else b"", largest))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [f"{folder}/{done}"], "length": [size], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{done}"], "length": [size], "records": [n]})

    cols = p.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "sha", "n_bytes", F.col("largest").cast("string").alias("largest"), "response")
    return cols.mapInPandas(task, "path string, length long, records long")


def header_of(data: bytes) -> dict[str, str] | None:
    """The fields of a WARC header at the start of data, or None."""
    if not VERSION.match(data):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    fields["_end"] = str(end + 4)
    return fields if fields.get("content-length", "").isdigit() and "warc-record-id" in fields else None


class Member:
    """Decodes the gzip member at an offset of an open file, block by block."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size, self.pos, self.z = f, at, size, at, zlib.decompressobj(31)

    def header(self) -> dict[str, str] | None:
        """The fields of a member that begins like a WARC record: a version line, then a header of any length."""
        data = bytearray()
        for part in self.parts(HEADER_READ):
            seen = len(data)
            data += part
            if len(data) >= VERSION_BYTES and not VERSION.match(data):
                return None
            if data.find(b"\r\n\r\n", max(0, seen - 3)) >= 0:
                break
        return header_of(bytes(data))

    def parts(self, step: int) -> Iterator[bytes]:
        """The decoded member, a read of step compressed bytes at a time and pieces of bounded size, whatever they expand to; it ends early where it does not decode."""
        try:
            while not self.z.eof and self.pos < self.size:
                data = self.f.read_at(min(step, self.size - self.pos), self.pos)
                self.pos += len(data)
                yield self.z.decompress(data, BLOCK)
                while self.z.unconsumed_tail and not self.z.eof:
                    yield self.z.decompress(self.z.unconsumed_tail, BLOCK)
        except zlib.error:
            return

    def whole(self, length: int) -> tuple[bytes, int] | None:
        """The decoded member, if it has that length, and the offset after it. No more than that is decoded."""
        data, n = [], 0
        for part in self.parts(BLOCK):
            data.append(part)
            n += len(part)
            if n > length:
                return None
        return (b"".join(data), self.pos - len(self.z.unused_data)) if self.z.eof and n == length else None


def record_at(f, at: int, size: int, chain: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose member starts at the offset: header, block, offset after it. chain: members that must follow, or the end."""
    if f.read_at(3, at) != MAGIC or (head := Member(f, at, size).header()) is None:
        return None
    begin, n = int(head["_end"]), int(head["content-length"])
    if (got := Member(f, at, size).whole(begin + n + 4)) is None:
        return None
    data, end = got
    if data[begin + n :] != b"\r\n\r\n":
        return None
    if chain and end < size and record_at(f, end, size, chain - 1) is None:
        return None
    return head, data[begin : begin + n], end


def records(f, size: int, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose members start in [start, stop)."""
    at, sure = start, start == 0
    while at < stop:
        if (got := record_at(f, at, size, 0 if sure else CHAIN)) is not None:
            head, block, at = got
            sure = True  # the next member starts right here
            yield head, block
            continue
        sure = False
        at += 1
        while at < stop:
            data = f.read_at(min(BLOCK, stop - at) + 2, at)
            if (k := data.find(MAGIC)) >= 0:
                at += k
                break
            at += max(1, len(data) - 2)


def payload(head: dict[str, str], block: bytes) -> tuple[int, str, bytes]:
    """Length and digest of the full payload, and the payload as far as the record has it: of an HTTP message its body, else the block."""
    http, _, body = block.partition(b"\r\n\r\n")
    if not head.get("content-type", "").lower().startswith("application/http"):
        body = block
    if head.get("warc-type") == "revisit":
        m = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)
        return int(m[1]) if m else 0, head.get("warc-payload-digest", "").partition(":")[2], b""
    return len(body), base64.b32encode(sha1(body).digest()).decode(), body


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_html: bool = True) -> DataFrame:
    """The records of the archives in manifest(path, length): READ."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("length") - 1), F.lit(split_bytes).cast("long"))
    splits = manifest.filter("length > 0").select("path", "length", F.explode(starts).alias("start"))
    splits = splits.repartition(max(8, splits.sparkSession.sparkContext.defaultParallelism * 4), "path", "start")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: None if x in (None, "null") else int(x)
        for b in batches:
            for path, size, start in zip(b.path, b.length, b.start, strict=True):
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(at) as f:
                    for head, block in records(f, size, start, min(start + split_bytes, size)):
                        n, digest, body = payload(head, block)
                        rows.append((
                            number(head.get("x-page-id")), head.get("warc-target-uri"), n, digest, head.get("warc-type"),
                            number(head.get("x-refers-to-page-id")), body.decode("utf-8", "replace") if with_html else None,
                        ))
                        held += len(body)
                        if held > 4 * BLOCK:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    return splits.mapInPandas(task, READ)


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in READ.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    return df.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC and read back from the archives."""
    folder = scratch(spark, "warc")
    manifest = written(write_archives(table(spark, sf_dir, "pages"), folder), "warc-manifest")
    return read_archives(manifest, with_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS s FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS largest FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((('0x' || substr(s, CAST(1 + (i // 4) * 5 AS INTEGER), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m"""

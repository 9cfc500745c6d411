"""WARC archives: write a record per page, read them back one gzip member at a time.

Writing.  Pages with equal payloads are found by digest: one partial aggregation over digests, then a join back that
Spark can split where one payload is very frequent.  The page with the largest id is the ``response``, the others
``revisit`` it and hold no payload.  Payloads below ``least_bytes`` are always responses.  Each record is one gzip
member, made in Python.  The archives are written by Spark's own file writer, so they appear by its commit protocol
on any file system: rows are the members' bytes, and the row separator is an empty gzip member, which every reader
of multi-member files passes over.

Reading is sequential: one member after the other is decompressed in small steps (``zlib.decompressobj``), its block
framed by Content-Length, its payload digested on the way and held against WARC-Payload-Digest.  A damaged record
raises.

Defined results: a null html is the empty payload; a null url gives a record without target; a null page id gives a
null id back and never outranks another; pages that repeat id and payload are all responses, and so are pages
without an id among themselves; an empty table gives an empty archive.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, map_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
#: Records of one archive file; bytes that the reader decompresses at a time.
RECORDS, STEP = 4000, 65_536
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member.  ``digest`` is the payload's SHA-1 in base32."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class Member:
    """A buffered byte source over one gzip member, decompressed step by step."""

    def __init__(self, data: memoryview, start: int):
        self.data, self.at, self.buffer = data, start, b""
        self.unpack = zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress one step; false at the member's end."""
        while not self.unpack.eof:
            pending = self.unpack.unconsumed_tail
            if not pending:
                pending = bytes(self.data[self.at:self.at + STEP])
                if not pending:
                    raise ValueError("truncated gzip member")
                self.at += len(pending)
            got = self.unpack.decompress(pending, STEP)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (k := self.buffer.find(mark)) < 0:
            if not self.more():
                raise ValueError("record ends inside a header")
        head, self.buffer = self.buffer[:k], self.buffer[k + len(mark):]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes in parts."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("record shorter than its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part

    def end(self) -> int:
        """Read to the member's end; where the next one starts."""
        while self.more():
            pass
        return self.at - len(self.unpack.unused_data)


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in head.split(b"\r\n"))}


def records(archive: bytes, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive file in order, each framed and verified."""
    data, at = memoryview(archive), 0
    while at < len(data):
        member = Member(data, at)
        if not member.more():  # an empty member stands between records
            at = member.end()
            continue
        version, _, head = member.until(b"\r\n\r\n").partition(b"\r\n")
        if version != VERSION:
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        warc = fields(head)
        revisit = warc["warc-type"] == "revisit"
        digest, length, kept, block, rest = hashlib.sha1(), 0, [], hashlib.sha1(), None
        http = b""
        for part in member.take(int(warc["content-length"])):
            block.update(part)
            if rest is None:
                http += part
                if (k := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, part = http[:k], http[k + 4:]
                rest = True
            digest.update(part)
            length += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(member.take(4)) != b"\r\n\r\n" or member.buffer or member.more():
            raise ValueError("record isn't closed by two line ends")
        own = warc["warc-payload-digest"].removeprefix("sha1:")
        said = int(fields(http.partition(b"\r\n")[2])["content-length"])
        if base64.b32encode(block.digest()).decode() != warc["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError("block digest differs")
        if not revisit and (base64.b32encode(digest.digest()).decode() != own or length != said):
            raise ValueError("payload digest or length differs")
        yield {"page_id": int(warc["x-page-id"]) if "x-page-id" in warc else None, "payload_bytes": said, "payload_digest": own,
               "record_type": warc["warc-type"], "refers_to": int(warc["x-refers-to-page-id"]) if revisit else None,
               "payload": b"".join(kept) if with_payload and not revisit else None}
        at = member.end()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS) -> None:
    """One record per page in archive files below ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(again.where("n > 1 and top is not null").select("digest", "top"), "digest", "left")
    rows = rows.withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))

    def work(batch: pa.RecordBatch) -> dict:
        values = (batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "top", "revisit"))
        return {"member": [record(p, u, body, base32_of_hex(d), top, again) for p, u, body, d, top, again in zip(*values)]}

    members = map_batches(rows.select("page_id", "url", "payload", "digest", "top", "revisit"), work, "member binary")
    members.select(F.col("member").cast("string")).write.mode("overwrite").option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archive files below ``path``; an archive is read in one task, front to back."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held: list[dict] = []
                for found in records(content.as_buffer().to_pybytes(), with_payload):
                    held.append(found)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=target)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=target)

    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").root
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path)


ORACLE = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(digest, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""

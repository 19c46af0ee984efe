"""WARC archives: a writer with revisit records and a splittable reader.

Writer.  Every page is one gzip member.  Of pages with equal payloads (of at
least ``least_bytes``), the one with the largest id is written as a response
and the others as revisits that refer to it and carry no payload.  Tasks write
one archive per partition and give it its name when it is whole.

Reader.  Archives are cut into byte ranges.  A task scans its range for the
gzip magic, takes a candidate for a member if its header decodes to a WARC
version line and another member or the end follows it, and owns the records that start inside its range, reading on past
the range's end for the last one; after a member it goes on at its end.  Its
memory is one buffer and one record.

Defined cases: a null page has an empty payload; empty payloads are equal to
each other; pages with a null id are responses and nothing refers to them;
rows that repeat id and payload of a response are responses too; urls may be
null (the header is left out) and lose their line breaks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, small_batches
from .tokenfiles import place

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def decided(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, refers_to``; refers_to is set for revisits.

    Only digests that occur twice are joined back, by id and digest, so the
    payloads move once and a hot payload is spread over the ids that share it.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("sha", F.sha1("payload"))
    ids = materialize(p.filter((F.length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha"), "warc-digests")
    groups = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = ids.join(groups, "sha").filter("page_id <> refers_to").distinct()
    return p.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, **columns) -> DataFrame:
    """Write the archives of ``pages`` below ``folder``; the manifest ``path, records, bytes``."""
    spark = pages.sparkSession
    small_batches(spark)
    target, path = place(folder)
    target.create_dir(path, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        out, at = place(folder)
        final, draft = f"{at}/part-{context.partitionId():06d}.warc.gz", f"{at}/_draft-{context.partitionId():06d}-{context.taskAttemptId()}"
        stream, records, size = None, 0, 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(b["page_id"], b["url"], b["payload"], b["refers_to"]):
                if stream is None:
                    stream = out.open_output_stream(draft)
                known = None if pd.isna(page_id) else int(page_id)
                revisit = not pd.isna(refers_to)
                member = _member(_record(known, url, bytes(payload), int(refers_to) if revisit else None, revisit))
                stream.write(member)
                records, size = records + 1, size + len(member)
        if stream is not None:
            stream.close()
            out.move(draft, final)
            yield pd.DataFrame({"path": [final], "records": [records], "bytes": [size]})

    rows = decided(pages, least_bytes, **columns).withColumn("page_id", F.col("page_id").cast("decimal(20,0)")) \
        .withColumn("refers_to", F.col("refers_to").cast("decimal(20,0)"))  # ids stay exact beside nulls
    return materialize(rows.mapInPandas(run, "path string, records long, bytes long"), "warc-manifest")


class _Member:
    """One gzip member, decoded from a position on as far as asked for."""

    def __init__(self, source: fs.FileSystem, file, at: int):
        self.file, self.at, self.unpacker, self.out = file, at, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.unpacker.eof:
            return False
        self.file.seek(self.at)
        raw = self.file.read(1 << 16)
        if not raw:
            return False
        self.out += self.unpacker.decompress(raw)
        self.at += len(raw) - len(self.unpacker.unused_data)
        return True

    def header(self) -> bytes | None:
        """The WARC header, or None if this is no member that begins with one."""
        try:
            while b"\r\n\r\n" not in self.out:
                begin = bytes(self.out[:5])
                if begin != b"WARC/"[:len(begin)] or not self.more():
                    return None
        except zlib.error:
            return None
        return bytes(self.out[:self.out.index(b"\r\n\r\n") + 4]) if self.out.startswith(b"WARC/") else None

    def rest(self) -> bytes | None:
        """The whole member, or None if it does not end well."""
        try:
            while self.more():
                pass
        except zlib.error:
            return None
        return bytes(self.out) if self.unpacker.eof else None


def records_in(source: fs.FileSystem, path: str, begin: int, end: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, header, block) of the records that start in the bytes ``begin <= offset < end`` of an archive."""
    with source.open_input_file(path) as f:
        at, known = begin, begin == 0  # known: a member ends or the archive begins here
        while at < end:
            f.seek(at)
            window = f.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0 or at + found >= end:
                at, known = at + max(len(window) - len(MAGIC) + 1, 1), False
                continue
            at, known = at + found, known and not found
            member = _Member(source, f, at)
            head = member.header()
            record = member.rest() if head is not None else None
            if not known and record is not None:
                # an archive inside a payload: what follows its member is no member
                f.seek(member.at)
                if f.read(len(MAGIC)) not in (MAGIC, b""):
                    record = None
            if head is None or record is None:  # the magic's bytes inside some member
                at, known = at + 1, False
                continue
            yield at, head, record[len(head):-4]
            at, known = member.at, True


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def read(spark: SparkSession, folder: str, manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """All records of the archives, one row each; every range of a file is a task's work of its own."""
    small_batches(spark)
    ranges = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("begin"),
                             F.col("bytes")).filter("bytes > 0")
    ranges = ranges.withColumn("end", F.least(F.col("begin") + range_bytes, "bytes"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "begin")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, _ = place(folder)
        names = [c.split()[0] for c in _RECORD.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            for c in ("page_id", "refers_to", "payload_bytes", "offset"):
                out[c] = pd.array([None if x is None else int(x) for x in (r[names.index(c)] for r in rows)], "Int64")
            return out

        for b in batches:
            for path, begin, end in zip(b["path"], b["begin"], b["end"]):
                rows, size = [], 0
                for offset, head, block in records_in(source, path, int(begin), int(end)):
                    h = _fields(head)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(_fields(http + b"\r\n").get("content-length", len(payload)))
                    revisit = h["warc-type"] == "revisit"
                    given = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if not revisit and (len(payload) != length or digest(payload) != given):
                        raise ValueError(f"{path} at {offset}: the payload is not what its header says")
                    url = h.get("warc-target-uri")
                    rows.append((_id(h["warc-record-id"]), None if url is None else unquote(url), h["warc-type"],
                                 _id(h.get("warc-refers-to")) if revisit else None, length, given,
                                 payload if with_payload and not revisit else None, path, offset))
                    size += len(payload)
                    if size > READ_BYTES or len(rows) >= 512:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    return ranges.select("path", "begin", "end").mapInPandas(run, _RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` and read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    records = read(spark, folder, write(pages, folder, least_bytes), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

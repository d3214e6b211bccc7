"""Web archives: WARC records in ZIP packages, written and range-read.

A package holds ``archive/data.warc.gz`` (one gzip member per record),
``indexes/index.cdx`` (a JSON line per record: url, offset, length) and
``datapackage.json``, all stored without ZIP compression.  The reader parses the
end-of-central-directory record, its ZIP64 form where sizes or counts overflow,
and the central directory; it finds where stored members begin, reads the index
by range, and reads each record by its own range.  Nothing is extracted.

Packages are files in the shared scratch folder, streamed out record by record
under names that no other attempt of a task takes.  Their list is a table that
Spark's own committers write, so a lost executor or a repeated task leaves no
half package in it; a file outside the list is never read.  Each package is then
read where it lies, by ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import open_shared, scratch_path, stash

#: Record bytes after which a package is closed, and the least payload that is worth a revisit record.
PACKAGE_BYTES, REVISIT_BYTES = 64 << 20, 100
#: Parts that the copies of a payload are dealt into.
SALTS = 32
#: Tasks that read packages; with more packages each reads several.
MOST_TASKS = 10_000
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: read(offset, length) -> bytes
Reader = Callable[[int, int], bytes]


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _safe(value: str) -> str:
    return json.dumps(value)[1:-1]  # no line ends inside a header


def page_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record without payload if ``refers_to`` names another page.  A page without an id gets a random one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = f"<urn:page:{_safe(page_id)}>" if page_id is not None else f"<{uuid.uuid4().urn}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _safe(url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record(headers, http + payload)
    headers += [("WARC-Refers-To", f"<urn:page:{_safe(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record(headers, http)


class PackageWriter:
    """A package streamed to ``out``; only its index is held, about 100 bytes a record."""

    def __init__(self, out: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.warc = self.zip.open(self._info(MEMBER), "w", force_zip64=True)
        self.index, self.size, self.bytes = [], 0, 0

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def add(self, url: str | None, data: bytes) -> None:
        packed = gzip.compress(data, 1, mtime=0)
        self.index.append(json.dumps({"url": url or "", "offset": self.size, "length": len(packed)}))
        self.warc.write(packed)
        self.size += len(packed)
        self.bytes += len(data)

    def close(self) -> None:
        self.warc.close()
        index = "".join(f"{line}\n" for line in self.index).encode()
        package = json.dumps({"profile": "data-package", "resources": [{"path": MEMBER, "bytes": self.size}, {"path": INDEX, "bytes": len(index)}]}).encode()
        self.zip.writestr(self._info(INDEX), index)
        self.zip.writestr(self._info("datapackage.json"), package)
        self.zip.close()


def central_directory(read: Reader, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (compression method, stored bytes, offset of the local header)."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature can stand in a comment
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP package, or cut short")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end of the central directory is missing")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    data, members, at = read(start, length), {}, 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n].decode()
        x, end = at + 46 + n, at + 46 + n + extra
        while x + 4 <= end:
            kind, m = struct.unpack_from("<HH", data, x)
            if kind == 1:  # ZIP64: the values that overflow, in this order
                wide = iter(struct.unpack_from(f"<{m // 8}Q", data, x + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            x += 4 + m
        members[name] = (method, packed, header)
        at = end + comment
    return members


def member_at(read: Reader, members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    """Offset and length of a stored member's bytes in the package."""
    method, length, header = members[name]
    if method != zipfile.ZIP_STORED:
        raise ValueError(f"{name} is compressed: it can't be read by range")
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{name} has no local header")
    n, extra = struct.unpack_from("<HH", local, 26)
    return header + 30 + n + extra, length


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def read_records(read: Reader, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records that the package's index lists, each by a range of its own."""
    members = central_directory(read, size)
    start, length = member_at(read, members, MEMBER)
    for line in read(*member_at(read, members, INDEX)).splitlines():
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > length:
            raise ValueError("the index points past the archive")
        yield parse_record(zlib.decompress(read(start + entry["offset"], entry["length"]), 31))


def _page(urn: str | None) -> str | None:
    return None if urn is None or not urn.startswith("<urn:page:") else json.loads(f'"{urn[len("<urn:page:") : -1]}"')


def page_row(headers: dict[str, str], block: bytes) -> tuple[str | None, str, int, str, str, str | None]:
    """page, url, payload bytes, payload digest, type, page referred to; a payload that doesn't match its digest is an error."""
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    length = int(next(v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length"))
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers.get('warc-record-id')} doesn't match its digest")
    return _page(headers.get("warc-record-id")), json.loads(f'"{headers["warc-target-uri"]}"'), length, digest, headers["warc-type"], _page(headers.get("warc-refers-to"))


_ROW = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _KINDS, strict=True)], names=[p.split()[0] for p in _ROW.split(", ")])


def _read(readers: Iterator[tuple[Reader, int]]) -> Iterator[pa.RecordBatch]:
    for read, size in readers:
        found = []
        for item in read_records(read, size):
            found.append(page_row(*item))
            if len(found) >= 5000:
                yield _rows(found)
                found = []
        if found:
            yield _rows(found)


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, date: str | None = None) -> DataFrame:
    """Write packages with a record for every row of ``pages`` (page_id, url, html) to ``folder``; returns path and records of each.

    Of rows with equal payloads of at least 100 bytes the one with the smallest
    page_id is a response and the others revisit it; smaller payloads are all
    responses.  A null html is an empty payload, a null url an empty one.  Rows
    that share the smallest page_id too are all responses; a null page_id never
    is the smallest unless all are null, and then all are responses.  Every
    record is dated ``date``, the time of the call if none is given.

    The files are written when the rows are; write those at once (``stash``).
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = own.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    # copies of a payload are dealt round by the partition that they come from, so that no task gets all of them
    wide = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = own.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(wide, ["digest", "salt"], "left")
    rows = met.select(F.col("page_id").cast("string").alias("page"), "url", "payload", "digest", F.when(later, F.col("first").cast("string")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_shared(folder)
        store.create_dir(base, recursive=True)
        writer = out = None

        def close() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(writer.index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                    writer = PackageWriter(out)
                writer.add(url, page_record(page, url, payload, digest, refers_to, date))
                if writer.bytes >= package_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return rows.mapInArrow(run, "path string, records long")


def read_packages(packages: DataFrame, tasks: int) -> DataFrame:
    """A row per record of the package files ``path``: page, url, payload_bytes, payload_digest, record_type, refers_to; by range reads where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def readers() -> Iterator[tuple[Reader, int]]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    store, name = open_shared(path)
                    with store.open_input_file(name) as f:
                        yield (lambda at, n, f=f: f.read_at(n, at)), f.size()

        yield from _read(readers())

    return packages.select("path").repartition(max(1, tasks)).mapInArrow(run, _ROW)


def archive_round_trip(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages`` to packages in the scratch folder and read every record back: one row per page."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    packages = stash(write_packages(pages, scratch_path(spark, ".packages"), package_bytes))
    found = read_packages(packages, min(packages.count(), MOST_TASKS))
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")

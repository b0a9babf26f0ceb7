"""WARC records in ZIP packages: written from pages, read back by ranges.

A package holds stored (uncompressed) members: a WARC file whose records are
gzip members of their own, and an index with the place of each record. The
reader finds the central directory from the end of the package, ZIP64 or not,
locates the members, and decodes only the byte ranges that the index names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_batches
from factloom.session import shared_dir

#: Payload bytes of a package, and records in it; a larger record has its own.
PACKAGE_BYTES, PACKAGE_RECORDS = 8 << 20, 5000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
NONE32, NONE16 = 0xFFFFFFFF, 0xFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit without it."""
    kind = "response" if refers_to is None else "revisit"
    mark = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{mark}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{mark}",
        f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False, comment: bytes = b"") -> bytes:
    """A ZIP file of stored members; ``zip64`` writes the large form throughout."""
    out, central, at = [], [], 0
    for name, data in members:
        label, crc, size = name.encode(), zlib.crc32(data), len(data)
        large = zip64 or size >= NONE32 or at >= NONE32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        shown = NONE32 if large else size
        local = struct.pack("<4s5H3I2H", LOCAL, 45 if large else 20, 0x800, 0, 0, 33, crc, shown, shown, len(label), len(extra)) + label + extra
        more = struct.pack("<HHQQQ", 1, 24, size, size, at) if large else b""
        central.append(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45 if large else 20, 0x800, 0, 0, 33, crc, shown, shown, len(label), len(more), 0, 0, 0, 0, NONE32 if large else at) + label + more)
        out += [local, data]
        at += len(local) + size
    directory, count = b"".join(central), len(members)
    large = zip64 or at >= NONE32 or count >= NONE16
    tail = b""
    if large:
        tail = struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, count, count, len(directory), at) + struct.pack("<4sIQI", LOCATOR64, 0, at + len(directory), 1)
    tail += struct.pack("<4s4H2IH", END, 0, 0, NONE16 if large else count, NONE16 if large else count, NONE32 if large else len(directory), NONE32 if large else at, len(comment)) + comment
    return b"".join([*out, directory, tail])


class ZipReader:
    """Members of a ZIP file by ranges; ``read(start, length)`` gives bytes of it."""

    def __init__(self, read, size: int):
        self.read = read
        tail_size = min(size, 22 + NONE16)
        tail = read(size - tail_size, tail_size)
        end = tail.rfind(END)
        # A comment may hold the signature: the record's own comment length must fit.
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<H2I", tail, end + 10)
        locator = size - tail_size + end - 20
        if locator >= 0 and (found := read(locator, 20))[:4] == LOCATOR64:
            record64 = read(struct.unpack_from("<Q", found, 8)[0], 56)
            if record64[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, at = struct.unpack_from("<3Q", record64, 32)
        directory, pos = read(at, length), 0
        self.members: dict[str, tuple[int, int]] = {}
        for _ in range(count):
            if directory[pos : pos + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, crc, packed, full, names, extras, comments = struct.unpack_from("<H4x3I3H", directory, pos + 10)
            header = struct.unpack_from("<I", directory, pos + 42)[0]
            name = directory[pos + 46 : pos + 46 + names].decode()
            extra = directory[pos + 46 + names : pos + 46 + names + extras]
            full, packed, header = _large_fields(extra, full, packed, header)
            if method != 0:
                raise ValueError(f"{name} is not stored")
            label, more = struct.unpack("<2H", read(header + 26, 4))
            self.members[name] = (header + 30 + label + more, packed)
            pos += 46 + names + extras + comments

    def range(self, name: str, start: int, length: int) -> bytes:
        at, size = self.members[name]
        if start < 0 or start + length > size:
            raise ValueError("range outside of the member")
        return self.read(at + start, length)

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name][1])


def _large_fields(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int, int]:
    pos = 0
    while pos + 4 <= len(extra):
        tag, size = struct.unpack_from("<2H", extra, pos)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, pos + 4))
            full = next(values) if full == NONE32 else full
            packed = next(values) if packed == NONE32 else packed
            header = next(values) if header == NONE32 else header
        pos += 4 + size
    return full, packed, header


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def reference_ids(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_sha1, refers_to) of the revisits.

    Of the records with equal payloads of at least ``min_bytes`` the one with
    the largest page_id is the response; rows that share that page_id are all
    responses. A null page_id is smaller than any other.
    """
    marks = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("payload_sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).filter(F.col("size") >= min_bytes)
    first = marks.groupBy("payload_sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    return marks.join(first, "payload_sha1").filter("refers_to IS NOT NULL AND (page_id IS NULL OR page_id < refers_to)").select("page_id", "payload_sha1", "refers_to").distinct()


def write_packages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Packages of pages(page_id, url, html) as files below ``path``.

    Every task fills packages of bounded size one after another. A package is
    one row of raw bytes, and the text sink writes each row to its own file;
    the line end it adds is the package's ZIP comment.
    """
    known = reference_ids(pages, min_bytes)
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("own_sha1"))
    joined = rows.join(known, rows["page_id"].eqNullSafe(known["page_id"]) & (rows["own_sha1"] == known["payload_sha1"]), "left").select(rows["page_id"], "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[bytes] = []
        index: list[str] = []
        at = paid = 0

        def package() -> pa.RecordBatch:
            nonlocal data, index, at, paid
            whole = zip_package([(DATA, b"".join(data)), (INDEX, "\n".join(index).encode())], comment=b"\n")
            data, index, at, paid = [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], ["package"])

        for batch in batches:
            for page, url, text, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                payload = text.encode("utf-8", "surrogatepass")
                one = record(page, url, payload, refers)
                if data and (paid + len(payload) > PACKAGE_BYTES or len(data) >= PACKAGE_RECORDS):
                    yield package()
                index.append(json.dumps({"id": page, "offset": at, "length": len(one)}))
                data.append(one)
                at += len(one)
                paid += len(payload)
        if data:
            yield package()

    packages = joined.mapInArrow(run, "package binary")
    packages.select(F.col("package").cast("string").alias("value")).write.mode("error").option("maxRecordsPerFile", "1").option("compression", "none").text(path)


SCHEMA = "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_packages(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record."""
    files = spark.read.format("binaryFile").load(path).select("content", "length")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for content in batch.column("content"):
            view = memoryview(content.as_buffer())
            package = ZipReader(lambda start, length, view=view: bytes(view[start : start + length]), len(view))
            for line in package.whole(INDEX).decode().split("\n"):
                place = json.loads(line)
                headers, payload = parse_record(package.range(DATA, place["offset"], place["length"]))
                mark = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and digest(payload) != mark:
                    raise ValueError(f"payload of page {place['id']} does not match its digest")
                refers = headers.get("WARC-Refers-To-Page-ID")
                rows.append((place["id"], int(headers["WARC-Payload-Length"]), mark, headers["WARC-Type"], None if refers is None else int(refers)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", *[f.split()[0] for f in SCHEMA.split(", ")]])

    return map_batches(files, run, f"page_id bigint, {SCHEMA}")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records of ``pages`` after they were written to packages and read back.

    Null html is an empty payload; an empty table writes nothing and gives no
    rows; repeated rows give repeated records.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    write_packages(own, path, min_bytes)
    return read_packages(spark, path)

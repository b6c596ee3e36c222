"""Web archives in ZIP packages: written per task, read back through directories and indexes."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import landed

# Payload bytes after which a task closes a package.
PACKAGE_BYTES = 4 << 20
STORED = 0
_SIZES32, _COUNT16 = 0xFFFFFFFF, 0xFFFF


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with `zip64` all sizes and places stand in ZIP64 fields."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        place, raw, crc, size = len(out), name.encode(), zlib.crc32(data), len(data)
        small = min(size, _SIZES32 - 1) if not zip64 else _SIZES32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, STORED, 0, 33, crc, small, small, len(raw), len(extra))
        out += raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, place) if zip64 else b""
        at = _SIZES32 if zip64 else place
        directory += struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, STORED, 0, 33, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, at
        )
        directory += raw + extra
    place, size, many = len(out), len(directory), len(members)
    out += directory
    if zip64:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, many, many, size, place)
        out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        many, size, place = _COUNT16, _SIZES32, _SIZES32
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, many, many, size, place, 0)
    return bytes(out)


class RangeFile:
    """Ranges of a package. Others with the same two members, over any store, serve as well."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = memoryview(data), len(data)

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError("a range lies outside the package")
        return bytes(self.data[start : start + length])


def zip_directory(file: RangeFile) -> dict[str, tuple[int, int, int]]:
    """Members by name: (place of the data, stored size, CRC), from the central directory.

    Only the end records, the directory and the members' local headers are read. A compressed or
    encrypted member is refused when it is asked for: its place is -1.
    """
    tail_at = max(0, file.size - (22 + 65535))
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    many, size, place = struct.unpack_from("<HII", tail, end + 10)
    if many == _COUNT16 or size == _SIZES32 or place == _SIZES32:
        locator = tail_at + end - 20
        if locator >= 0 and file.read(locator, 4) == b"PK\x06\x07":
            record = file.read(struct.unpack("<Q", file.read(locator + 8, 8))[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            many, size, place = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = file.read(place, size), 0, {}
    for _ in range(many):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, packed, plain = struct.unpack_from("<III", directory, at + 16)
        n, e, c = struct.unpack_from("<HHH", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8", "replace")
        extra = directory[at + 46 + n : at + 46 + n + e]
        k = 0
        while k + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                plain = next(values) if plain == _SIZES32 else plain
                packed = next(values) if packed == _SIZES32 else packed
                local = next(values) if local == _SIZES32 else local
            k += 4 + length
        if method == STORED and not flags & 1 and packed == plain:
            n_local, e_local = struct.unpack("<HH", file.read(local + 26, 4))
            out[name] = (local + 30 + n_local + e_local, plain, crc)
        else:
            out[name] = (-1, plain, crc)
        at += 46 + n + e + c
    return out


def member(file: RangeFile, directory: dict[str, tuple[int, int, int]], name: str) -> bytes:
    place, size, crc = directory[name]
    if place < 0:
        raise ValueError(f"{name} is not stored plainly")
    data = file.read(place, size)
    if zlib.crc32(data) != crc:
        raise ValueError(f"{name} is damaged")
    return data


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC record: a response, or where `first` is given a revisit of that page without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    address = "".join(c for c in url or "urn:none" if c >= " " and c != "\x7f")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{first}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_packages(pages: DataFrame, least: int = 0) -> DataFrame:
    """(name, content): ZIP packages with a WARC file and its index, for `pages` (page_id, url, html).

    Of equal payloads of at least `least` bytes the page with the smallest id keeps its payload.
    Only digests that occur under two ids are joined back, not pages.
    """
    # Pages whose payloads are equal share the digest; the record's own digest is made from bytes.
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), sha.alias("sha"))
    again = landed(
        page.where(F.octet_length("html") >= least)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("sha", "first"),
        "payloads",
    )
    revisit = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    records = page.join(again, "sha", "left").select("page_id", "url", "html", "sha", revisit.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        archive, index = bytearray(), []

        def package() -> pa.RecordBatch:
            nonlocal number
            name = f"part-{part:06d}-{number:06d}.zip"
            number += 1
            data = zip_bytes(
                [("archive/data.warc", bytes(archive)), ("indexes/index.cdx", "\n".join(index).encode())],
                zip64=len(archive) > 1 << 31,
            )
            archive.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "content"])

        for batch in batches:
            for page_id, url, html, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first)
                index.append(f"{len(archive)} {len(data)}")
                archive += data
                if len(archive) >= PACKAGE_BYTES:
                    yield package()
        if index:
            yield package()

    return records.mapInArrow(run, "name string, content binary")


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and referred page of a record; its digest is verified."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError("the payload does not match its record")

    def page(field: str) -> int | None:
        number = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    return page("WARC-Record-ID"), length, digest, kind, page("WARC-Refers-To")


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records in packages.

    `packages` has a column `content`, as the binaryFile source gives it. The index member tells the
    range of every record in the archive member; each is read by that range, nothing is unpacked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                file = RangeFile(value.as_py())
                directory = zip_directory(file)
                rows = []
                place, size, _ = directory["archive/data.warc"]
                for line in member(file, directory, "indexes/index.cdx").decode().split("\n"):
                    start, length = map(int, line.split(" "))
                    if place < 0 or start + length > size:
                        raise ValueError("the index does not fit the archive")
                    rows.append(parse_record(file.read(place + start, length)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                )

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return packages.select("content").mapInArrow(run, schema)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write every row of `pages` to packages in the shared folder and read the records back.

    Null html: an empty payload. Empty payloads are equal to each other. A null page_id never is the
    page referred to, unless all are null, and then each is a response. Rows that repeat the smallest
    page_id are each a response. A null url is written as urn:none. An empty table gives no package
    and no rows. Other columns are not read.
    """
    return read_packages(landed(write_packages(pages, least), "packages"))

"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

A package is a ZIP file with stored (uncompressed) members: ``archive/NNNN.warc.gz`` hold WARC
records, each its own gzip member, and ``indexes/index.cdxj`` says where each record lies. The reader
finds the end record from the file's tail, follows the ZIP64 locator where sizes need it, parses the
central directory, locates the index and the archive members, and then reads each record by its byte
range. Tasks write packages under names of their own into the shared folder and return rows of a
manifest; only rows of successful tasks count, so a lost executor leaves at worst an unlisted file.

Defined cases: a null html is an empty payload; of equal payloads of at least ``least_bytes`` bytes
the smallest page_id is the response (all rows of that id, if it repeats), the others revisit it;
a row with a null page_id is always a response and is never referred to; an empty table gives an
empty result; damaged packages and records raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, scratch_dir

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Packages are read in at most so many tasks.
MOST_TASKS = 10_000


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ----------------------------------------------------------------------------------


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit carries no payload."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("a WARC record is cut off")
    return headers, block.partition(b"\r\n\r\n")[2]


# --- packages ---------------------------------------------------------------------------------


class Package:
    """Collects records into members and gives the bytes of the finished ZIP file."""

    def __init__(self, member_bytes: int):
        self.member_bytes, self.members, self.index, self.size = member_bytes, [bytearray()], [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.members[-1] and len(self.members[-1]) + len(record) > self.member_bytes:
            self.members.append(bytearray())
        self.index.append((page_id, len(self.members) - 1, len(self.members[-1]), len(record)))
        self.members[-1] += record
        self.size += len(record)

    def finish(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for i, data in enumerate(self.members):
                with z.open(zipfile.ZipInfo(f"archive/{i:04d}.warc.gz"), "w", force_zip64=True) as f:
                    f.write(data)
            rows = sorted(self.index, key=lambda x: (x[0] is None, x[0] or 0))
            lines = (f"{'-' if p is None else p} {json.dumps({'filename': f'archive/{m:04d}.warc.gz', 'offset': at, 'length': n})}\n" for p, m, at, n in rows)
            z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(lines))
        return out.getvalue()


class Entry(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipRanges:
    """The directory of a ZIP file and byte ranges of its stored members; ``f`` must seek."""

    def __init__(self, f: BinaryIO, size: int):
        self.f = f
        tail_at = max(0, size - 22 - 0xFFFF - 20)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or 0xFFFFFFFF in (length, at):
            if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = self.read(struct.unpack_from("<Q", tail, end - 12)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
        self.entries = {e.name: e for e in self._directory(self.read(at, length), count)}

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        out = self.f.read(n)
        if len(out) != n:
            raise ValueError("the file is cut off")
        return out

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[Entry]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<HHHIIIHHHHHII", data, at + 10)
            name = data[at + 46 : at + 46 + n_name].decode()
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that do not fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            yield Entry(name, method, size, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        e = self.entries[name]
        if e.method != 0 or e.size != e.packed:
            raise ValueError(f"{name} is not stored")
        local = self.read(e.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        return e.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def package_records(f: BinaryIO, size: int) -> Iterator[tuple[int | None, dict[str, str], bytes]]:
    """(page_id, headers, payload) of each indexed record, by range reads."""
    ranges = ZipRanges(f, size)
    starts = {name: ranges.start(name) for name in ranges.entries if name.startswith("archive/")}
    for name in sorted(x for x in ranges.entries if x.startswith("indexes/")):
        for line in ranges.read(ranges.start(name), ranges.entries[name].size).decode().splitlines():
            key, _, where = line.partition(" ")
            where = json.loads(where)
            headers, payload = parse_record(ranges.read(starts[where["filename"]] + where["offset"], where["length"]))
            yield None if key == "-" else int(key), headers, payload


# --- Spark ------------------------------------------------------------------------------------


def with_origin(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, html, sha1, refers_to). Only ids and digests are grouped; html moves once, by page_id.

    A digest that very many pages share is joined by a broadcast, see ``join_counted``.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({"sha1": F.sha1(payload.cast("binary")), "n_bytes": F.octet_length(payload)})
    marks = rows.where(F.col("page_id").isNotNull() & (F.col("n_bytes") >= least_bytes)).select("page_id", "sha1")
    first = cut(marks.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "warc-origins")
    revisits = join_counted(marks, first, "sha1", "n").where("page_id > refers_to").select(F.col("page_id").alias("r_page"), F.col("sha1").alias("r_sha1"), "refers_to").distinct()
    return rows.join(revisits, (F.col("page_id") == F.col("r_page")) & (F.col("sha1") == F.col("r_sha1")), "left").select("page_id", "url", "html", "sha1", "refers_to")


def write_packages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, member_bytes: int = 4 << 20, package_bytes: int = 24 << 20) -> DataFrame:
    """Write all pages; returns the manifest (path, bytes, records)."""
    folder = folder or f"{scratch_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def store(package: Package) -> pa.RecordBatch:
            name = f"{folder}/{uuid.uuid4().hex}.wacz"
            files, path = pafs.FileSystem.from_uri(name)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            data = package.finish()
            with files.open_output_stream(path) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [name], "bytes": [len(data)], "records": [len(package.index)]})

        package = Package(member_bytes)
        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package.add(page_id, warc_record(page_id, url, (html or "").encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to))
                if package.size >= package_bytes:
                    yield store(package)
                    package = Package(member_bytes)
        if package.index:
            yield store(package)

    return cut(with_origin(pages, least_bytes).mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of every record of the listed packages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                files, path = pafs.FileSystem.from_uri(name)
                rows, held = [], 0
                with files.open_input_file(path) as f:
                    for page_id, headers, payload in package_records(f, size):
                        kind, digest, n = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                        if kind == "response" and (len(payload) != n or digest32(payload) != digest):
                            raise ValueError(f"page {page_id} of {name} differs from its digest")
                        origin = int(headers["warc-refers-to"][len("<urn:page:") : -1]) if kind == "revisit" else None
                        rows.append((page_id, headers.get("warc-target-uri"), kind, origin, payload, n, digest))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    n = max(1, min(MOST_TASKS, manifest.count()))
    return manifest.repartition(n).mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")

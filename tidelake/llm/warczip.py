"""WARC records in ZIP-packaged archives.

An archive is a ZIP file of stored members: `archive/data.warc.gz`, one gzip member for
each record, and `indexes/index.cdxj`, one line for each record with its place.  All
entries carry ZIP64 fields, and a ZIP64 end record stands before the plain one.

The reader takes the archive's tail, follows the ZIP64 locator to the central directory,
finds the members, reads the index, and range-reads the records; no member is ever
extracted, and memory is bounded by `_READ` bytes or one record.

A task writes each archive under a name of its own attempt and reports it only when it
is complete, so an attempt that is lost or repeated leaves no archive in the manifest.
Archives lie in the shared scratch folder.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import Scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_FULL = 24 << 20
_READ = 4 << 20


def plan_records(pages: DataFrame, scratch: Scratch, least: int = 1000) -> DataFrame:
    """The pages with digest and `response_id`: null for a response, else the page that
    the record revisits.

    Of equal payloads of at least `least` bytes the largest page_id is the response; rows
    that repeat it are responses too.  Null html is an empty payload.  A null page_id is
    never the largest, and a response if all page_ids of its payload are null."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = scratch.write(shared.where("n > 1 and last is not null").select("digest", "last"), "shared")
    rows = rows.join(shared, "digest", "left")
    revisits: Column = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "html", "digest", F.when(revisits, F.col("last")).alias("response_id"))


def _record(page_id: int | None, url: str | None, html: bytes, digest: str, response_id: int | None) -> bytes:
    kind = "response" if response_id is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(html)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if response_id is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {response_id}"]
    block = b"" if response_id is not None else html
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Zip:
    """Stored members with ZIP64 fields, in memory until the archive is full."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.entries: list[bytes] = []
        self.at = 0

    def add(self, name: str, parts: list[bytes]) -> None:
        size, check = sum(map(len, parts)), 0
        for p in parts:
            check = zlib.crc32(p, check)
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0x21, check, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra))
        extra_central = struct.pack("<HHQQQ", 1, 24, size, size, self.at)
        central = struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0x21, check, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra_central), 0, 0, 0, 0, 0xFFFFFFFF
        )
        self.entries.append(central + raw + extra_central)
        self.parts += [local, raw, extra, *parts]
        self.at += len(local) + len(raw) + len(extra) + size

    def finish(self) -> list[bytes]:
        directory = b"".join(self.entries)
        n = len(self.entries)
        end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), self.at)
        locator = struct.pack("<IIQI", 0x07064B50, 0, self.at + len(directory), 1)
        end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        return [*self.parts, directory, end64, locator, end]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, root: str) -> DataFrame:
    """One row (path, n_records, n_bytes) for each archive written below `root`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        packed: list[bytes] = []
        lines: list[bytes] = []
        at = 0

        def flush() -> pa.RecordBatch:
            nonlocal packed, lines, at
            archive = _Zip()
            archive.add(DATA, packed)
            archive.add(INDEX, [b"".join(lines)])
            path, size = f"{base}/{uuid.uuid4().hex}.wacz", 0
            with store.open_output_stream(path) as out:
                for part in archive.finish():
                    out.write(part)
                    size += len(part)
            row = pa.RecordBatch.from_pylist([{"path": path, "n_records": len(lines), "n_bytes": size}])
            packed, lines, at = [], [], 0
            return row

        for batch in batches:
            names = ("page_id", "url", "html", "digest", "response_id")
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                for page_id, url, html, digest, response_id in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                    one = _gzip(_record(page_id, url, html.encode("utf-8"), digest, response_id))
                    lines.append(json.dumps({"url": url, "page": page_id, "digest": digest, "offset": at, "length": len(one)}).encode() + b"\n")
                    packed.append(one)
                    at += len(one)
                    if at >= _FULL:
                        yield flush()
        if lines:
            yield flush()

    return records.mapInArrow(run, "path string, n_records long, n_bytes long")


class ArchiveReader:
    """Random access to the members of a ZIP file of stored members."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        self.members = dict(self._directory())

    def read(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"archive ends at {offset + len(data)}, before {offset + length}")
        return data

    def _directory(self) -> Iterator[tuple[str, tuple[int, int, int]]]:
        size = self.file.size()
        tail_at = max(0, size - 65_557)  # the end record with the longest comment
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of a central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == n or 0xFFFFFFFF in (length, start):
            spot = tail_at + at - 20
            magic, _, where, _ = struct.unpack("<IIQI", self.read(spot, 20))
            if magic != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            end64 = self.read(where, 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            n, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, at = self.read(start, length), 0
        for _ in range(n):
            magic, method, packed, plain, names, extras, comment, local = struct.unpack_from("<I6xH8xIIHHH8xI", directory, at)
            if magic != 0x02014B50:
                raise ValueError("damaged central directory")
            name = directory[at + 46 : at + 46 + names].decode()
            extra = directory[at + 46 + names : at + 46 + names + extras]
            packed, local = self._wide(extra, plain, packed, local)
            yield name, (method, local, packed)
            at += 46 + names + extras + comment

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                if plain == 0xFFFFFFFF:
                    wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if local == 0xFFFFFFFF:
                    local = wide.pop(0)
            at += 4 + size
        return packed, local

    def place(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the file."""
        method, local, length = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        magic, names, extras = struct.unpack("<I22xHH", self.read(local, 30))
        if magic != 0x04034B50:
            raise ValueError(f"{name} has no local header")
        return local + 30 + names + extras, length

    def lines(self, name: str) -> Iterator[dict]:
        start, length = self.place(name)
        rest, at = b"", 0
        while at < length:
            block = self.read(start + at, min(_READ, length - at))
            at += len(block)
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield json.loads(line)
        if rest:
            yield json.loads(rest)

    def records(self) -> Iterator[tuple[dict, bytes]]:
        """(headers, block) of every record that the index lists, in ranges of about `_READ` bytes."""
        start, _ = self.place(DATA)
        group: list[tuple[int, int]] = []
        for line in self.lines(INDEX):
            offset, length = line["offset"], line["length"]
            if group and (offset != sum(group[-1]) or offset + length - group[0][0] > _READ):
                yield from self._group(start, group)
                group = []
            group.append((offset, length))
        if group:
            yield from self._group(start, group)

    def _group(self, start: int, group: list[tuple[int, int]]) -> Iterator[tuple[dict, bytes]]:
        first = group[0][0]
        data = self.read(start + first, sum(group[-1]) - first)
        for offset, length in group:
            yield parse_record(zlib.decompress(data[offset - first : offset - first + length], 31))


def parse_record(data: bytes) -> tuple[dict, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def read_archives(manifest: DataFrame, root: str, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]) of
    every record of the archives that `manifest` lists.

    Length and digest of a response come from the bytes read, which must agree with its
    headers; a revisit has no payload of its own, only its headers tell of it."""
    columns = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    schema = columns + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for headers, block in ArchiveReader(file).records():
                        kind = headers["warc-type"]
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(headers["warc-payload-length"])
                        if kind == "response":
                            found = (len(block), hashlib.sha1(block).hexdigest())
                            if found != (size, digest):
                                raise ValueError(f"{path}: payload {found} does not agree with {(size, digest)}")
                        page, other = headers.get("warc-page-id"), headers.get("warc-refers-to-page")
                        row = {
                            "page_id": int(page) if page else None,
                            "url": headers.get("warc-target-uri"),
                            "record_type": kind,
                            "refers_to": int(other) if other else None,
                            "payload_bytes": size,
                            "payload_digest": digest,
                        }
                        if payload:
                            row["payload"] = block if kind == "response" else None
                            held += len(block)
                        rows.append(row)
                        if len(rows) >= 4096 or held >= _READ:
                            yield _rows(rows, payload)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, payload)

    return manifest.select("path").mapInArrow(run, schema)


def _rows(rows: list[dict], payload: bool) -> pa.RecordBatch:
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields + [("payload", pa.binary())] * payload))


def round_trip(pages: DataFrame, scratch: Scratch, least: int = 1000, payload: bool = False) -> DataFrame:
    """Write every page as a record and read all archives back."""
    root = scratch.path("archives")
    manifest = scratch.write(write_archives(plan_records(pages, scratch, least), root), "manifest")
    archives = max(1, manifest.count())
    return read_archives(manifest.repartition(min(archives, 2000)), root, payload)

"""Web archives in ZIP packages: records written to stored members, read back by range through directory and index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize, partitions_for, run_dir, text_slices

#: Payload bytes (uncompressed) after which a task starts another package.
PACKAGE_BYTES = 32 << 20
#: Packages that a reading task takes at most, once there are more than shuffle partitions.
PACKAGES_PER_TASK = 16
ARCHIVE_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PAGE_ID, LENGTH, REFERS_TO = "X-Page-Id", "X-Payload-Length", "X-Refers-To-Page-Id"
#: Signatures and sizes of the ZIP format; fixed values.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
ALL16, ALL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header_at: int


class ZipDirectory:
    """Reads the directory of a ZIP package from the end of a seekable file; members are not extracted."""

    def __init__(self, file, size: int):
        self.file = file
        self.members = {m.name: m for m in self._entries(size)}

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the package ends too early")
        return data

    def _directory(self, size: int) -> tuple[int, int, int]:
        """Entries, bytes and place of the central directory; from the ZIP64 record where the short one overflows."""
        tail_at = max(0, size - END_SIZE - ALL16)
        tail = self._at(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, place = struct.unpack_from("<HII", tail, at + 10)
        if ALL16 in (count,) or ALL32 in (length, place):
            locator = self._at(tail_at + at - LOCATOR_SIZE, LOCATOR_SIZE)
            if locator[:4] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            record = self._at(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, place = struct.unpack_from("<QQQ", record, 32)
        return count, length, place

    def _entries(self, size: int) -> Iterator[Member]:
        count, length, place = self._directory(size)
        data, at = self._at(place, length), 0
        for _ in range(count):
            if data[at : at + 4] != ENTRY:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            header_at = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # the ZIP64 field holds only what overflows, in this order
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = wide.pop(0) if full == ALL32 else full
                    packed = wide.pop(0) if packed == ALL32 else packed
                    header_at = wide.pop(0) if header_at == ALL32 else header_at
                extra = extra[4 + n :]
            yield Member(name, method, packed, full, header_at)
            at += ENTRY_SIZE + n_name + n_extra + n_comment

    def data_at(self, member: Member) -> int:
        """Place of a member's first byte, behind its local header."""
        head = self._at(member.header_at, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header_at + LOCAL_SIZE + n_name + n_extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member; a range of it is one read of the file."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        length = member.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > member.size:
            raise ValueError(f"range outside {name}")
        return self._at(self.data_at(member) + offset, length)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """A value on one header line."""
    return " ".join(value.split())


def record_id(page_id: int | None, url: str = "") -> str:
    """Id of the record of a page, which those that revisit it name; without a page id, that of its address."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'address:{url}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head but no body; length and digest are those of the whole payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = record_id(page_id, url)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}",
        f"WARC-Target-URI: {_header(url)}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"{LENGTH}: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"{PAGE_ID}: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"{REFERS_TO}: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return headers, rest[:length]


def _open_store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


class _Package:
    """One package in the making: compressed records and their index lines."""

    def __init__(self) -> None:
        self.data, self.index, self.payload = io.BytesIO(), [], 0

    def add(self, page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> None:
        at = self.data.tell()
        self.data.write(gzip.compress(record(page_id, url, payload, refers_to), 5, mtime=0))
        self.index.append(json.dumps({"url": url, "offset": at, "length": self.data.tell() - at}))
        self.payload += len(payload)

    def write(self, store: pyarrow.fs.FileSystem, folder: str) -> str:
        """Write under a name no other attempt uses, so a retried or doubled task never mixes with this one."""
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            package.writestr(ARCHIVE_MEMBER, self.data.getvalue())
            package.writestr(INDEX_MEMBER, "\n".join(self.index))
        return path


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html, refers_to)`` as ZIP packages; ``(path, records)`` per package that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_store(folder)
        store.create_dir(base, recursive=True)
        package = _Package()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([package.write(store, base)]), pa.array([len(package.index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for part in text_slices(batch, "html"):
                for page_id, url, html, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    package.add(page_id, url or "", (html or "").encode(), refers_to)
                    if package.payload >= package_bytes:
                        yield done()
                        package = _Package()
        if package.index:
            yield done()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long")


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """Every record of the packages ``(path)``: its page, payload length, digest, type and what it refers to.

    A package is opened, not extracted: its directory names the members, the index names the records, and each record
    is one range read. The digest of a response is computed from what was read and must be the one it states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open_store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    package = ZipDirectory(file, file.size())
                    yield pa.RecordBatch.from_pylist([_row(package, json.loads(x)) for x in package.read(INDEX_MEMBER).decode().split("\n") if x], schema=_SCHEMA)

    return packages.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _row(package: ZipDirectory, entry: dict) -> dict:
    headers, block = parse_record(zlib.decompress(package.read(ARCHIVE_MEMBER, entry["offset"], entry["length"]), 31))
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    length = int(headers[LENGTH.lower()])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != length or payload_digest(payload) != digest:
            raise ValueError(f"payload of {entry['url']} does not match its digest")
    page, refers = headers.get(PAGE_ID.lower()), headers.get(REFERS_TO.lower())
    return {"page_id": int(page) if page else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None}


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``refers_to``: the smallest page_id of an equal payload, null for that one.

    Only payloads that stand under more than one id travel: a row per such payload, joined by SHA-256, which is
    broadcast only if its file is small.
    """
    sha = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    keys = pages.where(size >= least_bytes).select(sha.alias("sha"), F.col("page_id").alias("id"))
    # a null id beside another one makes its row a revisit
    shared = keys.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id").isNull()).alias("nulls"))
    shared = materialize(shared.where("first < last OR (first IS NOT NULL AND nulls > 0)").select("sha", "first"), "shared-payloads")
    marked = pages.withColumn("__sha", sha).join(shared, F.col("__sha") == shared["sha"], "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return marked.select("page_id", "url", "html", refers.alias("refers_to"))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` and give what the archives say when read back.

    Null html is an empty payload, a null url an empty one. Of records with equal payloads of at least
    ``least_bytes`` bytes the smallest page_id is a response and others revisit it; rows that repeat this id are
    responses too; a row with a null id revisits if any id has its payload. An empty table writes no package and
    gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    folder = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    written = materialize(write_packages(with_revisits(rows, least_bytes), folder), "packages")
    n = written.count()
    tasks = max(1, min(n, partitions_for(spark)), -(-n // PACKAGES_PER_TASK))
    return read_packages(written.repartitionByRange(tasks, "path"), folder)  # a hash of few paths leaves tasks without any

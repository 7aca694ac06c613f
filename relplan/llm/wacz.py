"""WARC records in ZIP-packaged archives (WACZ), written by tasks and range-read in place.

Each writing task packs its records into one archive: ``archive/data.warc.gz``
(one gzip member per record) and ``indexes/index.cdxj``, both stored without
further compression, plus ``datapackage.json``.  Reading parses the end record,
the ZIP64 end record where there is one, and the central directory; it locates
the stored members by their local headers and then reads byte ranges of the
archive, so nothing is ever extracted.

Archives lie on any file system that ``pyarrow.fs`` can open.  A task writes
under a name of its own and only names that a finished task reported are read,
so a retried task leaves at worst an unread file.  The driver holds these names,
one for each archive.

Defined cases: a null payload is empty; equal payloads (of at least
``least`` bytes) share one response, that of the smallest id, and the others are
revisit records without a block; an empty table writes no archive; rows with
equal ids each get a record; other columns don't take part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relplan.sources import shared

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_TASK_BYTES = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if "://" not in path:
        path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}"
    return fs.FileSystem.from_uri(path)


# -- ZIP --------------------------------------------------------------------


class Packer:
    """Writes stored members one after another; sizes above 4 GB, or ``force64``, use ZIP64 fields."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, pieces: list[bytes]) -> None:
        crc, size = 0, 0
        for piece in pieces:
            crc, size = zlib.crc32(piece, crc), size + len(piece)
        raw, offset, wide = name.encode(), self.at, self.force64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = _FULL32 if wide else size
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        for piece in pieces:
            self._put(piece)
        self.members.append((raw, crc, size, offset))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.members:
            wide = self.force64 or size >= _FULL32 or offset >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            short = _FULL32 if wide else size
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, _FULL32 if wide else offset) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.force64 or start >= _FULL32 or size >= _FULL32 or n >= _FULL16:
            at64 = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, at64, 1))
            n, size, start = _FULL16, _FULL32, _FULL32
        self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def _read_at(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (compression method, first byte of the data, stored bytes) of every member."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _read_at(file, tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(END, 0, end)  # the signature may also be part of a comment
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if n == _FULL16 or length == _FULL32 or start == _FULL32:
        mark, _, at64, _ = struct.unpack("<4sIQI", _read_at(file, tail_at + end - 20, 20))
        if mark == LOCATOR64:
            record = _read_at(file, at64, 56)
            if record[:4] != END64:
                raise ValueError("the ZIP64 end record is missing")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
    central, found, at = _read_at(file, start, length), {}, 0
    for _ in range(n):
        if central[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, = struct.unpack_from("<H", central, at + 10)
        packed, full, names, extras, comment = struct.unpack_from("<IIHHH", central, at + 20)
        offset, = struct.unpack_from("<I", central, at + 42)
        name = central[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra = central[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, many = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{many // 8}Q", extra, 4))
                full = next(wide) if full == _FULL32 else full
                packed = next(wide) if packed == _FULL32 else packed
                offset = next(wide) if offset == _FULL32 else offset
            extra = extra[4 + many :]
        header = _read_at(file, offset, 30)
        if header[:4] != LOCAL:
            raise ValueError(f"the local header of {name} is missing")
        names_here, extras_here = struct.unpack_from("<HH", header, 26)
        found[name] = (method, offset + 30 + names_here + extras_here, packed)
        at += 46 + names + extras + comment
    return found


# -- WARC -------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, page_id: int | None, sha1: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; revisits carry no payload but its full length and digest."""
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{uri}')}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:] if ": " in line), payload


# -- Spark ------------------------------------------------------------------


_MANIFEST = "path string, records long, bytes long"


def write(pages: DataFrame, target: str, least: int = 0, level: int = 1, most_bytes: int = 64 << 20) -> DataFrame:
    """Pack ``pages`` (page_id, url, html) into archives below ``target``; returns (path, records, bytes).

    An archive is closed at ``most_bytes`` and the task goes on with another.
    """
    spark = pages.sparkSession
    plain = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn("sha", F.sha1("payload"))
    ids = plain.select("page_id", F.octet_length("payload").alias("n"), "sha")
    firsts = ids.where(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # only payloads that occur twice are looked up; each has one row here, so large groups of copies can be split
    marks = ids.join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).groupBy("page_id", "sha").agg(F.min("first").alias("first"))
    p, m = plain.alias("p"), marks.alias("m")
    table = p.join(m, F.col("p.page_id").eqNullSafe(F.col("m.page_id")) & (F.col("p.sha") == F.col("m.sha")), "left").select("p.page_id", "p.url", "p.payload", "m.first")

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(target)
        store.create_dir(root, recursive=True)
        pieces, index, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal pieces, index, size
            name, n, held = f"{root}/{uuid.uuid4().hex}.wacz", len(index), size
            with store.open_output_stream(name) as out:
                packer = Packer(out)
                packer.add(WARC, pieces)
                packer.add(INDEX, ["\n".join(index).encode()])
                packer.add("datapackage.json", [json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": WARC}, {"path": INDEX}]}).encode()])
                packer.close()
            pieces, index, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([held], pa.int64())], ["path", "records", "bytes"])

        for batch in it:
            for page, url, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                sha1, kind = digest(payload), "response" if first is None else "revisit"
                packed = gzip.compress(record(kind, url or "", page, sha1, payload, first), level, mtime=0)
                index.append(f"{quote(url or '-')} 20240101000000 " + json.dumps({"id": page, "digest": f"sha1:{sha1}", "offset": size, "length": len(packed)}))
                pieces.append(packed)
                size += len(packed)
                if size >= most_bytes:
                    yield close()
        if index:
            yield close()

    # not written as a table: on a local file system without Hadoop's native code each file costs its JVM two or three processes
    return spark.createDataFrame(table.mapInArrow(pack, _MANIFEST).collect(), _MANIFEST)


def read(spark, manifest: DataFrame, target: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record in the archives.

    Digest and length of a revisit are those its headers state; for a response
    they are computed from the payload that was read and held against the header.
    """

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(target)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in it:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    members = directory(file, file.size())
                    method, at, n = members[INDEX]
                    method_w, base, _ = members[WARC]
                    if method or method_w:
                        raise ValueError(f"{path}: members must be stored")
                    spots = [json.loads(line.split(" ", 2)[2]) for line in _read_at(file, at, n).decode().split("\n") if line]
                    rows, held = [], 0
                    for group in _ranges(spots, 4 << 20):
                        block = _read_at(file, base + group[0]["offset"], group[-1]["offset"] + group[-1]["length"] - group[0]["offset"])
                        for spot in group:
                            lo = spot["offset"] - group[0]["offset"]
                            fields, http, payload = parsed(gzip.decompress(block[lo : lo + spot["length"]]))
                            kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and digest(payload) != sha1:
                                raise ValueError(f"{path}: the payload at {spot['offset']} doesn't have its digest")
                            length = len(payload) if kind == "response" else int(http["Content-Length"])
                            page, to = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                            rows.append((int(page) if page else None, fields["WARC-Target-URI"], length, sha1, kind, int(to) if to else None, payload if kind == "response" else None))
                            held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files, total = manifest.agg(F.count("*"), F.sum("bytes")).first()
    # a task reads about one full archive; small ones share tasks, but none of the cores is idle
    tasks = max(1, min(files, 100_000, max(spark.sparkContext.defaultParallelism, -(-(total or 0) // _TASK_BYTES))))
    spread = manifest.select("path").coalesce(1).repartition(tasks)
    return spread.mapInArrow(unpack, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _ranges(spots: list[dict], most: int) -> Iterator[list[dict]]:
    """Records grouped into ranges of about ``most`` bytes to read at once."""
    group: list[dict] = []
    for spot in spots:
        if group and spot["offset"] + spot["length"] - group[0]["offset"] > most:
            yield group
            group = []
        group.append(spot)
    if group:
        yield group


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    target = shared.new_path(spark, "wacz")
    return read(spark, write(pages, target), target)


def packed(members: dict[str, bytes], force64: bool = False) -> bytes:
    """A small archive in memory."""
    out = io.BytesIO()
    packer = Packer(out, force64)
    for name, data in members.items():
        packer.add(name, [data])
    packer.close()
    return out.getvalue()


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
b AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
  list_aggregate(flatten(list_transform(range(0, 8), lambda i: list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)))), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM b
"""

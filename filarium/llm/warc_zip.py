"""Web archives in ZIP packages: writing, and reading by byte ranges without extraction.

A package holds stored members: ``archive/data.warc.gz`` (each record a gzip member of its own) and
``indexes/index.cdxj`` (a line per record with its place). The reader takes the end of the file,
finds the central directory, in its ZIP64 form too, goes from there to the index, and then reads
records by range. A task writes packages under names of its own, and only the packages that a
finished task lists are read, so a lost or repeated task leaves no trace.

Packages lie in the shared folder, which must be one that pyarrow can open.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import new_path, stored

#: Payloads from this many bytes on are written once.
LEAST = 1000
#: A package is closed at so many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 50_000
#: Records of a block of this size are read together.
BLOCK = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the formats.
END, END64, LOCATOR64, ENTRY, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- writing

def typed(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, digest, refers_to): refers_to is set for revisits.

    Of equal payloads of at least LEAST bytes those with the largest page_id are responses, the
    rest revisits; a null id counts as smaller than any other. Null html is an empty payload.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    long = rows.where(F.octet_length("html") >= LEAST).select("page_id", "digest")
    groups = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = (long.join(groups.select("digest", "refers_to"), "digest").where("page_id is null or page_id < refers_to").distinct())
    again = again.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "refers_to")
    # ids spread the payloads evenly, whatever the size of a group of copies
    return rows.join(again, rows["page_id"].eqNullSafe(again["id"]) & (rows["digest"] == again["d"]), "left").drop("id", "d")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    again = refers_to is not None
    block = http if again else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if again:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Out:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


class _Package:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        system, name = _open(self.path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(name)
        self.zip = zipfile.ZipFile(_Out(self.stream), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page_id, url, record: bytes) -> None:
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = packed.compress(record) + packed.flush()
        self.data.write(raw)
        self.lines.append(json.dumps({"page": page_id, "url": url, "offset": self.size, "length": len(raw)}).encode() + b"\n")
        self.size += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.writelines(self.lines)
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.size


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write packages into a folder; a stored table (path, records, bytes) of them."""
    def run(batches):
        package, done = None, []
        for t in batches:
            d = {n: t.column(i) for i, n in enumerate(t.schema.names)}
            for at in range(0, t.num_rows, 64):
                for page_id, url, html, digest, refers_to in zip(*(d[c].slice(at, 64).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    package = package or _Package(folder)
                    package.add(page_id, url, _record(page_id, url, html.encode("utf-8"), digest, refers_to))
                    if package.size >= PACKAGE_BYTES or len(package.lines) >= PACKAGE_RECORDS:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "records", "bytes"])

    return stored(typed(pages).mapInArrow(run, "path string, records long, bytes long"), "packages")


# ---------------------------------------------------------------- reading

def _at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    data = file.read(length)
    if len(data) < length:
        raise ValueError(f"the archive ends before byte {offset + length}")
    return data


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """First byte and length of each stored member, from the central directory."""
    tail_at = max(0, size - 22 - FULL16)
    tail = _at(file, tail_at, size - tail_at)
    end = len(tail) - 22
    while end >= 0 and not (tail[end:end + 4] == struct.pack("<I", END) and struct.unpack_from("<H", tail, end + 20)[0] <= len(tail) - end - 22):
        end = tail.rfind(struct.pack("<I", END), 0, end + 3) if end > 0 else -1
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    directory_end = tail_at + end
    if directory_end >= 20:
        kind, _, at64 = struct.unpack("<IIQ", _at(file, directory_end - 20, 16))
        if kind == LOCATOR64:
            kind, = struct.unpack("<I", _at(file, at64, 4))
            if kind != END64:
                raise ValueError("no ZIP64 end of the central directory where its locator points")
            count, length, start = struct.unpack("<QQQ", _at(file, at64 + 32, 24))
            directory_end = at64
    ahead = directory_end - length - start  # bytes before the first member, as in self-extracting archives
    raw, at, out = _at(file, start + ahead, length), 0, {}
    for _ in range(count):
        if struct.unpack_from("<I", raw, at)[0] != ENTRY:
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, plain, names, extras, remarks = struct.unpack_from("<IIHHH", raw, at + 20)
        local, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46:at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = raw[at + 46 + names:at + 46 + names + extras], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # only the fields that are full in the entry follow, in this order
                wide = list(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, x + 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                local = wide.pop(0) if local == FULL32 else local
            x += 4 + n
        at += 46 + names + extras + remarks
        if method == 0 and not flags & 1:
            head = _at(file, local + ahead, 30)
            if struct.unpack_from("<I", head)[0] != LOCAL:
                raise ValueError(f"{name} is not where the central directory says")
            out[name] = local + ahead + 30 + sum(struct.unpack_from("<HH", head, 26)), packed
    return out


def _lines(file, start: int, length: int) -> Iterator[bytes]:
    rest, at = b"", start
    while at < start + length:
        part = _at(file, at, min(BLOCK, start + length - at))
        at += len(part)
        *full, rest = (rest + part).split(b"\n")
        yield from full
    if rest:
        yield rest


def index(packages: DataFrame) -> DataFrame:
    """Rows (path, offset, length, page_id) of all records, offsets from the start of the package."""
    def run(batches):
        for t in batches:
            for path in t.column(0).to_pylist():
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    found = members(file, file.size())
                    if DATA not in found or INDEX not in found:
                        raise ValueError(f"{path} holds no stored archive with its index")
                    first, size = found[DATA]
                    rows = []
                    for line in _lines(file, *found[INDEX]):
                        entry = json.loads(line)
                        if entry["offset"] + entry["length"] > size:
                            raise ValueError(f"{path}: a record lies beyond its archive")
                        rows.append((first + entry["offset"], entry["length"], entry["page"]))
                        if len(rows) == 10_000:
                            yield _entries(path, rows)
                            rows = []
                    yield _entries(path, rows)

    return packages.select("path").mapInArrow(run, "path string, offset long, length long, page_id long")


def _entries(path: str, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))],
                                      names=["path", "offset", "length", "page_id"])


def parse(raw: bytes) -> dict:
    """Header fields, HTTP length and payload of a packed record."""
    record = zlib.decompress(raw, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    return {"fields": fields, "length": length, "payload": payload}


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:"):-1]) if urn and urn != "<urn:page:None>" else None


def read(entries: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    A response whose payload does not have its digest or length raises an error.
    """
    def run(batches):
        file, now = None, None
        for t in batches:
            rows = list(zip(*(t.column(i).to_pylist() for i in range(3))))
            out, i = [], 0
            while i < len(rows):
                path, first, _ = rows[i]
                if path != now:
                    system, name = _open(path)
                    file, now = system.open_input_file(name), path
                j, end = i, first
                while j < len(rows) and rows[j][0] == path and rows[j][1] == end and (j == i or end - first < BLOCK):
                    end, j = end + rows[j][2], j + 1
                data = _at(file, first, end - first)
                for _, offset, length in rows[i:j]:
                    r = parse(data[offset - first:offset - first + length])
                    kind, digest = r["fields"]["WARC-Type"], base64.b32decode(r["fields"]["WARC-Payload-Digest"][5:]).hex()
                    if kind == "response" and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["length"]):
                        raise ValueError(f"{path}: the payload at {offset} is not what its record says")
                    row = [_page(r["fields"]["WARC-Record-ID"]), r["fields"].get("WARC-Target-URI"), r["length"], digest, kind,
                           _page(r["fields"].get("WARC-Refers-To"))]
                    out.append([*row, r["payload"] if kind == "response" else None] if with_payload else row)
                i = j
                if with_payload:
                    yield _rows(out, True)
                    out = []
            yield _rows(out, with_payload)

    near = entries.repartition("path", F.floor(F.col("offset") / (8 * BLOCK))).sortWithinPartitions("path", "offset")
    return near.select("path", "offset", "length").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else ""))


def _rows(out: list, with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names[:len(kinds)])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' packages into the shared folder and read them back."""
    return read(index(write(pages, new_path(pages.sparkSession, "warc"))))

"""Web archives: the ARC to WARC converter, and archives written and read through Spark.

An ARC file is a version block and records, each with one header line of the fields its version declares and as
many bytes as that line says. Version 1 has URL, address, date, type and length; version 2 also result code,
checksum, location, offset and file name. The converter reads either by the declared lengths alone and synthesises
WARC records: identifiers (name-based UUIDs of the source's place and digest), dates in ISO form,
types (warcinfo for the version block, response for HTTP, resource for the rest) and SHA-1 digests of block and payload.

Archives are written with each record as a gzip member of its own. The two line ends that close a record are a member too,
with the archive's own mark in its header: it is the line separator with which Spark's text sink writes the members and its text
source splits the files, so files of any size are read in parallel, and any bytes may stand in a block. The mark is drawn anew
for each archive, so no payload can hold it. Archives of others are read as whole files (`read_files`, 2 GB each at most).

Cases: a null payload is empty; null addresses, dates or types become `-` or absent fields; dates that are no day of the
calendar become the year 1; white space in a URL is percent-encoded; payloads of any length and bytes pass; an empty table
gives no archives and no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, slices

#: Fields of a record's header line, by ARC version. Fixed values of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Names of the version blocks' second lines. Fixed values of the format.
ARC_TITLES = {1: "1 0", 2: "2 0"}
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:strataline:arc")


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    at: int = 0
    version: int = 1

    @property
    def url(self) -> str:
        return self.fields.get("URL", "-")


@dataclass
class WarcRecord:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def to_bytes(self) -> bytes:
        """The record without the two line ends that close it."""
        lines = ["WARC/1.0", f"WARC-Type: {self.kind}", *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block


def arc_line(text: str | None) -> str:
    """A header field: no white space, never empty."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in text.encode()).encode("latin-1").decode("utf-8") if text else "-"


def write_arc(records: list[ArcRecord], version: int, origin: str = "filedesc://strataline.arc", date: str = "20000101000000") -> bytes:
    """An ARC file of either version."""
    body = f"{ARC_TITLES[version]} strataline\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = {"URL": origin, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    out = bytearray()
    for fields, block in [(head, body), *((r.fields, r.block) for r in records)]:
        values = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(len(out)), "Filename": "strataline.arc", **fields, "Archive-length": str(len(block))}
        out += " ".join(arc_line(values.get(k)) for k in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"
    return bytes(out)


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first; header lines by its version, blocks by declared lengths."""
    at, version, names = 0, None, ARC_FIELDS[1]
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"the header line at byte {at} is cut")
        values = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if version is None:
            length = int(values[-1])
            block = raw[end + 1 : end + 1 + length]
            version = int(block.split(b" ", 1)[0])
            names = block.split(b"\n")[1].decode().split(" ")
            fields = dict(zip(ARC_FIELDS[len(values) > 5 and 2 or 1], values, strict=False))
        else:
            if len(values) > len(names):  # a type with spaces in it
                values = [*values[:3], " ".join(values[3 : len(values) - len(names) + 4]), *values[len(values) - len(names) + 4 :]]
            fields = dict(zip(names, values, strict=True))
            length = int(fields["Archive-length"])
            block = raw[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"the record at byte {at} is cut")
        yield ArcRecord(fields, block, at, version)
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head (with its empty line) and payload."""
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def _date(digits: str) -> str:
    """Fourteen digits of a day and time that exist."""
    padded = digits.ljust(14, "0")[:14]
    try:
        datetime.datetime(*(int(padded[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))))
    except ValueError:
        padded = ""
    return padded if digits.isascii() and digits.isdigit() and len(digits) >= 8 and padded else "00010101000000"


def to_warc(record: ArcRecord, first: bool = False) -> WarcRecord:
    """The equivalent WARC record."""
    date = record.fields.get("Archive-date", "")
    date = _date(date)
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    name = f"{record.url} {date} {sha1_base32(record.block)}"
    headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(SPACE, name)}>", "WARC-Date": iso}
    if first:
        return WarcRecord("warcinfo", headers | {"Content-Type": "application/warc-fields"}, f"format: WARC File Format 1.0\r\nconformsTo: ARC version {record.version}\r\nsource: {record.url}\r\n".encode())
    headers["WARC-Target-URI"] = record.url
    if record.fields.get("IP-address", "-") not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = record.fields["IP-address"]
    if record.block.startswith(b"HTTP/"):
        _, payload = split_http(record.block)
        return WarcRecord("response", headers | {"WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Block-Digest": f"sha1:{sha1_base32(record.block)}", "Content-Type": "application/http; msgtype=response"}, record.block)
    kind = record.fields.get("Content-type", "-")
    return WarcRecord("resource", headers | {"WARC-Payload-Digest": f"sha1:{sha1_base32(record.block)}", "WARC-Block-Digest": f"sha1:{sha1_base32(record.block)}", "Content-Type": kind if kind != "-" else "application/octet-stream"}, record.block)


def as_revisit(record: WarcRecord, refers_to: str, uri: str | None = None) -> WarcRecord:
    """A record whose payload another holds: its HTTP head stays, its payload goes, its payload digest names the whole."""
    head, _ = split_http(record.block)
    headers = record.headers | {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": refers_to, "WARC-Truncated": "length", "WARC-Block-Digest": f"sha1:{sha1_base32(head)}"}
    return WarcRecord("revisit", headers | ({"WARC-Refers-To-Target-URI": uri} if uri else {}), head)


def read_warc(raw: bytes) -> Iterator[WarcRecord]:
    """Records by declared lengths."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            headers[key.decode()] = value.strip().decode("utf-8", "replace")
        length = int(headers.pop("Content-Length"))
        block = raw[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"the record at byte {at} is cut")
        yield WarcRecord(headers.pop("WARC-Type"), headers, block)
        at = end + 4 + length


def closing(mark: str) -> bytes:
    """The gzip member that ends a record: two line ends, the mark as its file name."""
    raw = b"\r\n\r\n"
    deflated = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = deflated.compress(raw) + deflated.flush()
    return b"\x1f\x8b\x08\x08\0\0\0\0\0\xff" + mark.encode() + b"\0" + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def member(raw: bytes) -> bytes:
    """A gzip member."""
    deflated = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflated.compress(raw) + deflated.flush()


def _separated(options, path: str):
    """Reader or writer options for the mark in the archive's path: bytes as they are, members split by the closing one."""
    mark = path.rstrip("/").rpartition("/")[2]
    return options.option("encoding", "ISO-8859-1").option("lineSep", closing(mark).decode("latin-1"))


def write_archives(records: DataFrame, path: str) -> None:
    """Records (a binary column `record` of gzip members) as WARC files; path ends with a name never used before."""
    _separated(records.select(F.col("record").cast("string").alias("value")).write, path).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """What write_archives wrote, a row a record: record_type, headers (map) and block, by declared lengths; files are split freely."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 256)):
            held = [r for raw in batch.column("value").to_pylist() for r in read_warc(_gunzip(raw))]
            if held:
                yield _rows(held)

    members = _separated(spark.read, path).text(path).select(F.col("value").cast("binary").alias("value"))
    return members.mapInArrow(run, _ROW)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """WARC files of any origin, plain or gzipped, as rows like read_archives'; each file is one task's."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                whole = raw.as_py()
                held: list[WarcRecord] = []
                for record in read_warc(_gunzip(whole) if whole[:2] == b"\x1f\x8b" else whole):
                    held.append(record)
                    if len(held) >= 256:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _ROW)


_ROW = "record_type string, headers map<string,string>, block binary"


def _rows(records: list[WarcRecord]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.kind for r in records]), pa.array([list(r.headers.items()) for r in records], pa.map_(pa.string(), pa.string())), pa.array([r.block for r in records], pa.binary())], names=["record_type", "headers", "block"])


def _gunzip(raw: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while raw:
        one = zlib.decompressobj(31)
        out += [one.decompress(raw), one.flush()]
        if not one.eof:
            raise ValueError("a gzip member is cut")
        raw = one.unused_data
    return b"".join(out)

"""Media columns: Netpbm and BMP images to numpy arrays, area-resized tiles and difference hashes.

Images are decoded by their own headers (PBM, PGM and PPM, plain or raw, 8 or 16 bits; BMP uncompressed with
1, 4, 8, 24 or 32 bits, top-down or bottom-up), resized by area means from an integral image, and written as NPY tiles.
Any bytes can be laid out losslessly as a grey image of 64 columns.

Cases: a null image gives null results; bytes that are no readable image give null results but for their own length and digest
(media_bytes, media_sha256); a null or empty text is a payload of 64 zero bytes; payloads of any
length are taken whole (rows of the image grow); equal payloads give equal images, tiles and hashes; an
empty table gives an empty table; columns of the input with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import settled, slices, utf8

WIDTH = 64


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Raw PGM of an array of bytes (rows, columns)."""
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Bottom-up BMP with a grey palette of 256."""
    rows, columns = pixels.shape
    padded = np.zeros((rows, (columns + 3) // 4 * 4), np.uint8)
    padded[:, :columns] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4) * np.array([1, 1, 1, 0], np.uint8)
    start = 14 + 40 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + padded.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 8, 0, padded.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + padded.tobytes()


def decode_netpbm(raw: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as an array (rows, columns[, 3]) and its declared maximum; bytes, or 16 bits where the maximum is over 255."""
    kind = raw[:2]
    wanted = 2 if kind in (b"P1", b"P4") else 3
    fields, at = [], 2
    while len(fields) < wanted:
        m = re.compile(rb"(?:\s+|#[^\n\r]*)*(\d+)").match(raw, at)
        if m is None:
            raise ValueError("the Netpbm header is cut")
        fields.append(int(m[1]))
        at = m.end()
    columns, rows = fields[:2]
    top = fields[2] if wanted == 3 else 255
    if not 0 < top < 1 << 16:
        raise ValueError("the Netpbm maximum is out of range")
    planes = 3 if kind in (b"P3", b"P6") else 1
    shape = (rows, columns, 3) if planes == 3 else (rows, columns)
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", raw[at:])
        values = np.array(list(re.sub(rb"\s", b"", body)), np.int64) - 48 if kind == b"P1" else np.array(body.split(), np.int64)
        pixels = values[: rows * columns * planes].reshape(shape).astype(np.uint16 if top > 255 else np.uint8)
        return (1 - pixels) * np.uint8(255) if kind == b"P1" else pixels, top
    at += 1  # one white-space byte ends the header
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, rows * ((columns + 7) // 8), at).reshape(rows, -1), axis=1)[:, :columns]
        return (1 - bits) * np.uint8(255), top
    if kind not in (b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    return np.frombuffer(raw, ">u2" if top > 255 else np.uint8, rows * columns * planes, at).reshape(shape), top


def decode_bmp(raw: bytes) -> np.ndarray:
    """An uncompressed BMP: grey where its palette is grey, else (rows, columns, 3) in red, green, blue."""
    start, size, columns, rows, _, bits, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or packing == 3 and bits < 16:
        raise ValueError("a BMP of this packing isn't read")
    height, stride = abs(rows), (columns * bits + 31) // 32 * 4
    lines = np.frombuffer(raw, np.uint8, height * stride, start).reshape(height, stride)
    lines = lines[::-1] if rows > 0 else lines
    if bits == 16 or packing == 3 and bits == 32:
        masks = struct.unpack_from("<III", raw, 14 + 40) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        values = lines[:, : columns * bits // 8].copy().view(f"<u{bits // 8}")
        return np.stack([_channel(values, mask) for mask in masks], axis=2)
    if bits >= 24:
        return lines[:, : columns * bits // 8].reshape(height, columns, bits // 8)[:, :, 2::-1]
    if bits < 8:
        unpacked = np.unpackbits(lines, axis=1).reshape(height, -1, bits)
        lines = (unpacked * (1 << np.arange(bits)[::-1]).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
    palette = np.frombuffer(raw, np.uint8, 4 * ((start - 14 - size) // 4), 14 + size).reshape(-1, 4)[:, 2::-1]
    index = lines[:, :columns]
    return palette[:, 0][index] if (palette == palette[:, :1]).all() else palette[index]


def _channel(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask as 8 bits."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    return np.rint(((values & mask) >> low) * (255 / (mask >> low))).astype(np.uint8)


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples as they are stored, and the one that stands for white."""
    return (decode_bmp(raw), 255) if raw[:2] == b"BM" else decode_netpbm(raw)


def grey(pixels: np.ndarray, top: int = 255) -> np.ndarray:
    """Luma by ITU-R BT.601 of a colour image; samples scaled from their declared maximum to 255."""
    out = pixels.astype(np.float64) * (255 / top)
    return out if out.ndim == 2 else out @ np.array([0.299, 0.587, 0.114])


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means from the integral image, exact at fractional borders."""
    height, width = pixels.shape
    integral = np.zeros((height + 1, width + 1))
    integral[1:, 1:] = pixels.cumsum(axis=0).cumsum(axis=1)

    def at(edges: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.minimum(edges.astype(int), limit)
        return low, np.minimum(low + 1, limit), edges - low

    r0, r1, rf = at(np.arange(rows + 1) * height / rows, height)
    c0, c1, cf = at(np.arange(columns + 1) * width / columns, width)
    lines = integral[r0] * (1 - rf)[:, None] + integral[r1] * rf[:, None]
    corners = lines[:, c0] * (1 - cf) + lines[:, c1] * cf
    return np.diff(np.diff(corners, axis=0), axis=1) * (rows * columns) / (height * width)


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 area means is above its left neighbour's (1e-6 apart at least)."""
    small = area_resize(pixels, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-6).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = 32) -> bytes:
    """A tile of side x side bytes in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def as_image(payload: bytes) -> bytes:
    """Zero-padded bytes as a grey image of 64 columns: PGM for an even number of rows, BMP for an odd one."""
    padded = payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))
    pixels = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return encode_bmp(pixels) if len(pixels) % 2 else encode_pgm(pixels)


def text_images(docs: DataFrame, text: str = "text", image: str = "image") -> DataFrame:
    """docs with the text's UTF-8 bytes as an image (binary) instead of the text, and n_bytes before padding."""
    kept = [f for f in docs.schema.fields if f.name not in (text, image, "n_bytes")]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType(), False), T.StructField(image, T.BinaryType(), False)])

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = utf8(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array([len(x) for x in raw], pa.int64()), pa.array([as_image(x) for x in raw], pa.binary())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


FEATURES = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("difference_hash", T.StringType()), ("tile", T.BinaryType())]


def features(raw: bytes | None, side: int = 32) -> tuple:
    """Of one stored image: its samples' digests, its own, the difference hash and an NPY tile; nulls where it can't be read."""
    if raw is None:
        return (None,) * len(FEATURES)
    own = (len(raw), hashlib.sha256(raw).hexdigest())
    try:
        pixels, top = decode(raw)
        if not pixels.size:
            raise ValueError("an image without pixels")
        plane = grey(pixels, top)
        shown = (difference_hash(plane), npy_tile(plane, side))
    except (ValueError, IndexError, OverflowError, ZeroDivisionError, struct.error):
        return (None, None, None, *own, None, None)
    samples = np.ascontiguousarray(pixels).tobytes()
    return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), *own, *shown)


def image_features(images: DataFrame, image: str = "image", side: int = 32) -> DataFrame:
    """images with FEATURES of the stored image instead of the image; tiles have side x side bytes."""
    names = [n for n, _ in FEATURES]
    kept = [f for f in images.schema.fields if f.name not in (image, *names)]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in FEATURES)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [features(x, side) for x in part.column(image).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[f.name for f in schema.fields])

    return images.mapInArrow(run, schema)

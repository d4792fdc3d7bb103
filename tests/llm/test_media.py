import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from strataline.llm import media
from strataline.llm.q_media import op5_media_columns

RNG = np.random.default_rng(5)


def test_netpbm_kinds():
    assert media.decode(b"P2 # c\n2 2\n# d\n9\n1 2\n3 9\n")[0].tolist() == [[1, 2], [3, 9]]
    assert media.decode(b"P1\n3 1\n1 0 1")[0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0b10000000]))[0].tolist() == [[0, *[255] * 7, 0]]
    assert media.decode(b"P6\n1 1\n255\nabc")[0].tolist() == [[[97, 98, 99]]]
    assert media.decode(b"P5\n1 2\n65535\n\x01\x00\x00\x02")[0].tolist() == [[256], [2]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3")[0].tolist() == [[[1, 2, 3]]]


@pytest.mark.parametrize("shape", [(1, 64), (7, 5), (64, 64), (3, 1)])
def test_round_trips(shape):
    pixels = RNG.integers(0, 256, shape, np.uint8)
    assert (media.decode(media.encode_pgm(pixels))[0] == pixels).all()
    assert (media.decode(media.encode_bmp(pixels))[0] == pixels).all()


def test_area_resize_is_the_area_mean():
    pixels = RNG.integers(0, 256, (13, 10)).astype(float)
    fine = np.repeat(np.repeat(pixels, 8, axis=0), 9, axis=1)  # 104 x 90: cells of 13 x 10
    want = fine.reshape(8, 13, 9, 10).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(pixels, 8, 9), want)


def test_tiles_are_npy():
    tile = np.load(io.BytesIO(media.npy_tile(np.full((5, 64), 7.0))))
    assert tile.shape == (32, 32) and tile.dtype == np.uint8 and (tile == 7).all()
    assert media.difference_hash(np.tile(np.arange(64.0), (4, 1))) == "f" * 16
    assert media.difference_hash(np.full((3, 64), 9.0)) == "0" * 16


def test_query_reads_back_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.as_image(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert by_text.setdefault(raw, r.feature) == r.feature


def test_nulls_lengths_and_names(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 64, "c"), (4, "é" * 50_000, "d"), (4, "é" * 50_000, "d")], "doc_id long, text string, image string")
    stored = media.text_images(docs)
    got = {r.doc_id: r for r in media.image_features(stored).collect()}
    assert [got[k].payload_bytes for k in (1, 2, 3, 4)] == [64, 64, 64, 100_032]
    assert got[1].payload_sha256 == got[2].payload_sha256
    assert media.image_features(spark.createDataFrame([(None,)], "image binary")).collect()[0].payload_bytes is None
    assert media.image_features(media.text_images(docs.limit(0))).count() == 0


def test_declared_maximum_and_masks():
    assert media.grey(*media.decode(b"P2\n2 1\n9\n0 9")).tolist() == [[0, 255]] and media.grey(*media.decode(b"P5\n1 1\n65535\n\xff\xff")).tolist() == [[255]]
    head = lambda bits, packing, more: struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + len(more)) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, bits, packing, 0, 0, 0, 0, 0) + more
    assert media.decode_bmp(head(16, 0, b"") + struct.pack("<HH", 31 << 10, 0)).tolist() == [[[255, 0, 0]]]
    assert media.decode_bmp(head(16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F)) + struct.pack("<HH", 63 << 5 | 31, 0)).tolist() == [[[0, 255, 255]]]
    assert media.decode_bmp(head(32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)) + bytes([1, 2, 3, 4])).tolist() == [[[1, 2, 3]]]


@pytest.mark.parametrize("raw", [b"", b"P5", b"P5\n4 4\n255\nab", b"BM", b"BM" + bytes(60), b"P2\n1 1\n0\n0", b"P2\n2 2\n9\n1 x", b"P9\n1 1\n255\na", b"P5\n0 0\n255\n"])
def test_unreadable_images_give_nulls(raw):
    got = media.features(raw)
    assert got[3:5] == (len(raw), hashlib.sha256(raw).hexdigest()) and [x for k, x in enumerate(got) if k not in (3, 4)] == [None] * 5

import base64
import glob
import gzip
import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm import common, q_warc, warc

BLOCKS = st.binary(max_size=40) | st.sampled_from([b"\r\n\r\n", b"WARC/1.0\r\n\r\n", b"\n\nhttp://x 1 2 3 4\n", b"HTTP/1.1 200 OK\r\n\r\n\x00\xff"])


@settings(max_examples=150, deadline=None)
@given(st.lists(BLOCKS, max_size=6), st.sampled_from([1, 2]))
def test_arc_round_trip_and_conversion(blocks, version):
    records = [warc.ArcRecord({"URL": f"http://h/{k}", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html"}, b) for k, b in enumerate(blocks)]
    read = list(warc.read_arc(warc.write_arc(records, version)))
    assert read[0].url.startswith("filedesc:") and read[0].version == version
    assert [(r.url, r.block) for r in read[1:]] == [(r.url, r.block) for r in records]
    made = [warc.to_warc(r, k == 0) for k, r in enumerate(read)]
    raw = b"".join(m.to_bytes() + b"\r\n\r\n" for m in made)
    back = list(warc.read_warc(raw))
    assert [(b.kind, b.headers, b.block) for b in back] == [(m.kind, m.headers, m.block) for m in made]
    for m, block in zip(made[1:], blocks, strict=True):
        assert m.kind == ("response" if block.startswith(b"HTTP/") else "resource")
        assert m.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and m.headers["WARC-IP-Address"] == "1.2.3.4"
        payload = warc.split_http(block)[1] if m.kind == "response" else block
        assert m.headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert m.headers["WARC-Record-ID"].startswith("<urn:uuid:")


def test_cut_archives_are_errors():
    whole = warc.write_arc([warc.ArcRecord({"URL": "http://a"}, b"abc")], 1)
    with pytest.raises(ValueError):
        list(warc.read_arc(whole[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_warc(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 9\r\n\r\nab"))


def plain(pages):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        last = max((x for x in groups[html or ""] if x is not None), default=None)
        other = len(groups[html or ""]) > 1 and last is not None and i != last
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", last if other else None))
    return sorted(out, key=str)


def read_back(spark, frame):
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(q_warc.converted(q_warc.with_revisits(frame)), path)
    return sorted((tuple(r) for r in q_warc.page_rows(warc.read_archives(spark, path)).collect()), key=str)


def test_revisits_nulls_ties_and_odd_pages(spark):
    pages = [(1, "http://a/x y", "same"), (2, None, "same"), (9, "http://é/ü", "same"), (9, "http://z", "same"), (3, "u", None), (4, "u", ""), (5, "u", "alone \r\n\r\nWARC/1.0\r\n"), (None, "u", "same"), (None, "u", "none has an id"), (None, "v", "none has an id"), (6, "u", "é\n" * 30_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("extra", "n")
    assert read_back(spark, frame) == plain(pages)
    # the version blocks are warcinfo records; files are WARC files of gzip members that any reader takes
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(q_warc.converted(q_warc.with_revisits(frame).coalesce(2)), path)
    rows = warc.read_archives(spark, path).collect()
    kinds = [r.record_type for r in rows]
    assert kinds.count("warcinfo") in (1, 2) and len(kinds) == len(pages) + kinds.count("warcinfo")
    assert b"ARC version" in next(bytes(r.block) for r in rows if r.record_type == "warcinfo")
    same = lambda rs: sorted((r.record_type, sorted(r.headers.items()), bytes(r.block)) for r in rs)
    assert same(rows) == same(warc.read_files(spark, path).collect())
    names = glob.glob(path.removeprefix("file://") + "/part-*")
    records = [r for name in names for r in warc.read_warc(gzip.open(name).read())]
    assert len(records) == len(rows) and all(not r.block or r.kind != "warcinfo" or r.block.startswith(b"format:") for r in records)


def test_split_files_and_dates(spark):
    frame = spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(3000)], "page_id long, url string, html string").coalesce(1)
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(q_warc.converted(q_warc.with_revisits(frame)), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = warc.read_archives(spark, path)
        assert back.rdd.getNumPartitions() > 3 and sorted(r.page_id for r in q_warc.page_rows(back).collect()) == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    dates = [warc.to_warc(warc.ArcRecord({"URL": "u", "Archive-date": d}, b"x")).headers["WARC-Date"] for d in ("20010203040506", "20010203", "20011399", "2001", "20010230000000", "-")]
    assert dates == ["2001-02-03T04:05:06Z", "2001-02-03T00:00:00Z", *["0001-01-01T00:00:00Z"] * 4]
    assert q_warc.with_revisits(frame.limit(0)).count() == 0


def test_minimum_length(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert [r.refers_to for r in q_warc.with_revisits(frame, 3).collect()] == [None, None]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in q_warc.op4_arc_to_warc(spark, sf).collect()), key=str) == plain(pages)

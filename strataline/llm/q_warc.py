"""op4: pages as legacy archives, converted to WARC files with revisits, and read back."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, warc

#: Payloads shorter than this are never revisits.
MIN_BYTES = 0
_START = datetime.datetime(2000, 1, 1)


def page_record(page_id: int | None, url: str | None, payload: bytes) -> warc.ArcRecord:
    """A page as an ARC record: an HTTP message whose head carries the page's id."""
    date = _START + datetime.timedelta(seconds=(page_id or 0) % 10**9)
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
    return warc.ArcRecord({"URL": warc.arc_line(url), "IP-address": "0.0.0.0", "Archive-date": date.strftime("%Y%m%d%H%M%S"), "Content-type": "text/html"}, head.encode() + payload)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with refers_to and refers_url: the largest page_id of an equal payload and its URL, null for that page itself.

    Payloads meet by digest, aggregated before the shuffle; only digests that occur twice are looked up, in lanes, as one
    may hold a large share of the pages. Pages without page_id refer to any page that has one.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.unhex(F.sha2("html", 256)))
    long_enough = keyed.where(F.octet_length("html") >= min_bytes) if min_bytes else keyed
    facts = long_enough.groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url")).where("n > 1 and last is not null").drop("n")
    met = common.salted_lookup(keyed, facts, "key", 8, F.xxhash64("page_id", "url"))
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return met.select("page_id", "url", "html", F.when(other, F.col("last")).alias("refers_to"), F.when(other, F.col("last_url")).alias("refers_url"))


#: Bytes of payload of one legacy archive, at most, or one page.
ARC_BYTES = 4 << 20


def _legacy(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Pages (page_id, url, payload, refers_to, refers_url) by archive."""
    held: list[tuple] = []
    size = 0
    for batch in (part for whole in batches for part in common.slices(whole, 256)):
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "refers_url")]
        for i, u, payload, to, there in zip(*columns[:2], common.utf8(batch.column("html")), *columns[2:], strict=True):
            if held and size + len(payload) > ARC_BYTES:
                yield held
                held, size = [], 0
            held.append((i, u, payload, to, there))
            size += len(payload)
    if held:
        yield held


def converted(pages: DataFrame) -> DataFrame:
    """WARC records (gzip members) of pages: some megabytes of them become an ARC file of one version or the other in turn, which the
    converter reads: its version block gives a warcinfo record, each page a response or a revisit."""

    @common.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(_legacy(batches)):
            legacy = warc.read_arc(warc.write_arc([page_record(i, u, p) for i, u, p, _, _ in rows], 1 + n % 2))
            out = [warc.member(warc.to_warc(next(legacy), first=True).to_bytes())]
            for record, (_, _, payload, to, url) in zip(legacy, rows, strict=True):
                made = warc.to_warc(record)
                if to is not None:
                    target = warc.to_warc(page_record(to, url, payload))
                    made = warc.as_revisit(made, target.headers["WARC-Record-ID"], target.headers["WARC-Target-URI"])
                    made.headers["X-Refers-To-Page-Id"] = str(to)
                out.append(warc.member(made.to_bytes()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return pages.mapInArrow(run, "record binary")


def page_rows(archives: DataFrame) -> DataFrame:
    """A row per page record read back; a response's digest and length are taken from its bytes, a revisit's from its headers."""

    @common.settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, headers, block in zip(batch.column("record_type").to_pylist(), batch.column("headers").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if kind not in ("response", "revisit"):
                    continue
                headers = dict(headers)
                head, payload = warc.split_http(block)
                own = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                digest = warc.sha1_base32(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = len(payload) if kind == "response" else int(own["content-length"])
                to = headers.get("X-Refers-To-Page-Id")
                rows.append((int(own["x-page-id"]) if "x-page-id" in own else None, size, digest, kind, int(to) if to else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    path = common.scratch_path(spark, "warc")
    warc.write_archives(converted(with_revisits(pages)), path)
    return page_rows(warc.read_archives(spark, path))


QUERIES = {"op4_arc_to_warc": op4_arc_to_warc}
SQL = {
    "op4_arc_to_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::BIGINT) AS parts FROM d),
c AS (SELECT *, array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31) + 1, 1)), '')), '') AS digest FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM c
""",
}
